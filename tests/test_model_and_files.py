"""Headers, file forms, ingest and parameter files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tesselum import model
from tesselum.functions import bits
from tesselum.operators import cohort, rows
from tesselum.sources import cell_files as f
from tesselum.sources import csv_cells, rules

TYPED = model.Header().add("HD", MP="0.325", UN="micron").add("MA", ID="DAPI", TY="f").add("CA", ID="count", TY="i").add("CA", ID="label", TY="Z").add("CA", ID="celltype", TY="A", LV="tumor,stroma,immune").add("GA", ID="knn", TY="B")
CELLS = [(1, 1.0, 2.0, 5, 6, 12.5, 42, "cell\tA\\", 2, [2, 3, 4]), (bits.signed(1 << 63) + 7, 0.1, 2.0, -1, bits.signed(1 << 63), 0.0, -7, "", 0, [])]


def _close(a, b):
    return [tuple(struct.unpack("<f", struct.pack("<f", v))[0] if isinstance(v, float) else v for v in r) for r in a] == [tuple(struct.unpack("<f", struct.pack("<f", v))[0] if isinstance(v, float) else v for v in r) for r in b]


@pytest.mark.parametrize("encode", [f.to_text, f.to_binary])
def test_round_trip_of_typed_cells(encode):
    data = encode(TYPED, CELLS)
    header, back = f.decode(data)
    back = list(back)
    assert header.text() == TYPED.text() and _close(back, CELLS)
    assert encode(header, back) == data


def test_text_to_binary_to_text():
    text = f.to_text(TYPED, CELLS)
    h, r = f.from_text(text)
    h, r = f.from_binary(f.to_binary(h, r))
    assert f.to_text(h, r) == text


def test_truncation_magic_and_version():
    data = f.to_binary(TYPED, CELLS * 400)
    raw = f.unblock(data)
    for cut in (raw[:-8], raw[:-1], raw[:-5000]):
        with pytest.raises(f.Truncated):
            list(f.from_binary(cut)[1])
    with pytest.raises(f.Truncated):
        list(f.from_binary(data[:-40])[1])
    with pytest.raises(ValueError, match="neither"):
        f.decode(b"XYZ1")
    with pytest.raises(ValueError, match="version"):
        f.from_binary(raw[:4] + b"\x09\x00" + raw[6:])
    with pytest.raises(ValueError, match="reserved"):
        f.to_binary(TYPED, [(struct.unpack("<Q", f.END)[0], *CELLS[0][1:])])


def test_blocks_are_gzip_and_headers_are_replaced_without_recoding():
    import gzip

    data = f.to_binary(TYPED, CELLS * 3000)
    assert data.endswith(f.EMPTY_BLOCK) and gzip.decompress(data) == f.unblock(data)
    new = TYPED.program("a note").add("SA", ID="0", SM="x" * 70_000)
    out = f.replace_header(data, new)
    assert f.from_binary(out)[0].text() == new.text() and _close(f.from_binary(out)[1], CELLS * 3000)
    first = len(f.blocks(f.preamble(TYPED)))
    assert out.endswith(data[first:])


def test_forms_by_name():
    assert [f.form_of(n) for n in ("a.cyf", "a.byf", "-")] == ["text", "binary", "binary"]
    with pytest.raises(ValueError, match="legacy"):
        f.form_of("a.ocyf")


def test_standard_flags_are_added_once():
    h = model.Header().standard_flags()
    assert len(h.of("FL")) == 11 and h.standard_flags().text() == h.text() and model.Header.parse(h.text()).text() == h.text()


def test_header_tags():
    h = TYPED.program("one").program("two")
    assert [t.fields.get("PP") for t in h.of("PG")] == [None, "1"] and h.markers == ["DAPI"]
    assert h.add("MA", ID="DAPI", CH="1").of("MA")[0].fields == {"ID": "DAPI", "TY": "f", "CH": "1"}
    assert h.renamed({"DAPI": "DNA"}).markers == ["DNA"] and TYPED.check() == [] and len(model.Header().check()) == 2


def test_files_through_spark(spark, tmp_path):
    df = spark.createDataFrame([(r[0], *r[1:]) for r in CELLS], csv_cells.schema(TYPED))
    for name in ("a.cyf", "b.byf"):
        f.write(df, TYPED, f"{tmp_path}/{name}")
        back, header = f.read(spark, f"{tmp_path}/{name}")
        assert header.text() == TYPED.text() and _close([tuple(r)[:10] for r in back.collect()], [tuple(r) for r in df.collect()])
    both, _ = f.read(spark, f"{tmp_path}/*.?yf")
    assert both.count() == 4 and both.schema["celltype"].metadata["levels"] == ["tumor", "stroma", "immune"]


def test_pack_layout(spark):
    h = model.Header().add("MA", ID="m", TY="f").add("CA", ID="area", TY="f").standard_flags().add("FL", ID="m+", RG="pflag", BI="0")
    df = spark.createDataFrame([(1, 2.0, 3.0, 4, 5, 6.0, 7.0)], csv_cells.schema(h))
    data = f.pack(df, h, [("1", "roi", [(0, 0), (1, 0), (1, 1)])])
    assert data[:4] == b"CYFV" and struct.unpack_from("<HHQI", data, 4) == (5, 0, 1, 2)
    at = 20 + 3 + 6 + 2
    at += -at % 8
    assert struct.unpack_from("<Q2f2Q2f", data, at) == (1, 2.0, 3.0, 4, 5, 6.0, 7.0)
    assert struct.unpack_from("<I", data, at + 40) == (1,) and data.count(b"BuildGraph") == 1


CSV = "CellID,X,Y,Hoechst,PD-1,CD4,lda,CD8{extra}\n0,10,10,100,1,4,4,3{a}\n1,11,11,101,2,5,junk,4{b}\n"


def test_ingest(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text(CSV.format(extra=",CD4p,Region,IC,qp,skip", a=",1,1,0,9,8", b=",0,2,3,9,8"))
    df, h = csv_cells.read(spark, str(p), markers=["Hoechst", "PD-1", "CD4", "CD8"], microns=0.5, unit="pixel", ignore=["skip"], sample=3)
    got = df.orderBy("id").collect()
    assert df.columns[7:] == ["Hoechst", "PD1", "CD4", "CD8", "lda", "IC"] and h.markers == ["Hoechst", "PD1", "CD4", "CD8"]
    assert [(r["id"], r["x"], r["cflag"], r["pflag"], r["lda"]) for r in got] == [(3 << 32, 10, 8, 4, 4), ((3 << 32) + 1, 11, 32, 0, 0)]
    assert h.check() == [] and h.microns == 0.5 and len(h.of("PG")) == 1


def test_ragged_rows_and_missing_columns_fail(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(CSV.format(extra="", a=",9", b=""))
    with pytest.raises(Exception, match="has not 8 fields"):
        csv_cells.read(spark, str(p), markers=["CD4"], microns=1, unit="micron")[0].collect()
    with pytest.raises(ValueError, match="lacks"):
        csv_cells.read(spark, str(p), markers=["CD4"], microns=1, unit="micron", x="x0")


def test_parameter_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("CD3,10,100\nPD1,2.5,50\n")
    (tmp_path / "g2.csv").write_text('n,"Marker","Gate"\n1,"PD-1",0\n')
    (tmp_path / "r.csv").write_text("inner,outer,or,and,l,g,label\n0,20,-1,0,0,0,all\n10,50,6,1,1,0,some\n")
    (tmp_path / "p.csv").write_text("# c\n1,0,255,0,0,1,tumor\n0,0,0,0,0,1,other\n")
    (tmp_path / "roi.csv").write_text('Id,Name,Text,type,all_points\n1,"a, ""b""",t,Polygon,"0,0 10,0 x 10,10"\n2,n,,Polygon,-1\n')
    at = lambda n: str(tmp_path / n)
    assert rules.gates(spark, at("g.csv")) == {"CD3": (10, 100), "PD1": (2.5, 50)} and rules.gates(spark, at("g2.csv")) == {"PD1": (1.0, 1e8)}
    assert [(r.label, r.outer, r.local) for r in rules.rings(spark, at("r.csv"))] == [("all", 20, False), ("some", 50, True)]
    assert rules.palette(spark, at("p.csv")) == [(1, 0, "tumor"), (0, 0, "other")]
    (roi,) = rules.regions(spark, at("roi.csv"), 2.0).collect()
    assert (roi["name"], [tuple(v) for v in roi["verts"]]) == ('a, "b"', [(0, 0), (20, 0), (20, 20)])


def test_flag_truth_table_with_the_sign_bit(spark):
    values = [*range(8), bits.signed(1 << 63), bits.signed((1 << 63) + 5)]
    df = spark.createDataFrame([(v,) for v in values], "pflag long")
    for mask in (1, 5, 1 << 63, (1 << 63) | 1):
        for fn, py in ((bits.has_all, lambda v, m: v & m == m), (bits.has_any, lambda v, m: v & m != 0), (bits.has_none, lambda v, m: v & m == 0)):
            assert [r[0] for r in df.select(fn(F.col("pflag"), mask)).collect()] == [py(v % (1 << 64), mask) for v in values]
    assert df.select(bits.bits_of(F.col("pflag"))).collect()[-1][0] == [0, 2, 63]
    with pytest.raises(ValueError, match="outside"):
        bits.bit_mask(64)


def test_filter_without_criteria(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (2, 1, 2.0)], "cflag long, pflag long, v double")
    assert rows.filter_cells(df).count() == 2 and rows.filter_cells(df, any_field=True).count() == 0
    assert [r["cflag"] for r in rows.filter_cells(df, [rows.Unit(por=1)]).collect()] == [0]
    with pytest.raises(ValueError, match="no column"):
        rows.filter_cells(df, fields=[("w", ">", 1)])


def test_painted_area_of_near_and_far_pairs(spark):
    one = sum(2 * w + 1 for _, w in cohort.geometry.disc(20.0))
    for gap, low, high in ((10, one + 1, 2 * one - 1), (100, 2 * one, 2 * one), (0, one, one)):
        df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0, 0), (1, 0, float(gap), 0.0, 0, 0)], "id long, sample_id long, x double, y double, cflag long, pflag long")
        assert low <= cohort.painted_area(df).first()["pixels"] <= high


def test_cohort_categories_add_up(spark):
    data = [(i, 0, float(i * 7 % 50), float(i), i % 4, i % 3, i % 3) for i in range(20)]
    df = spark.createDataFrame(data, "id long, sample_id long, x double, y double, cflag long, pflag long, IC int")
    h = model.Header().add("HD", MP="0.5", UN="pixel").standard_flags()
    doc = json.loads(cohort.cohort_json(df, h, ["IC"]).first()["json"])
    by = {c["compartment"]: c["n"] for c in doc["compartments"]}
    names = {b["name"]: b["bit"] for b in doc["cflag_bits"]}
    assert by[-1] == doc["n_cells"] == 20 == by[names["IC!=0"]] + by[names["IC=0"]]
    assert sum(x["n"] for x in doc["flag_histogram"]) == sum(x["n"] for x in doc["catcols"][0]["histogram"]) == 20
    with pytest.raises(ValueError, match="MP"):
        cohort.cohort_json(df, model.Header())


def test_files_are_streamed_in_pieces(tmp_path):
    """Records across the borders of blocks and pieces, headers alone, and files that are cut short."""
    import io

    rows = [(k, 1.5, 2.5, 3, 4, 0.25, k, "x" * (k % 300), k % 3, list(range(k % 7))) for k in range(30_000)]
    for name in ("a.cyf", "b.byf"):
        out = f.Writer(f"{tmp_path}/{name}", TYPED)
        for r in rows:
            out.add(r)
        out.close()
        data = (tmp_path / name).read_bytes()
        header, got = f.streamed(io.BytesIO(data))
        assert header.text() == TYPED.text() and [tuple(r) for r in got] == rows
        assert list(f.decode(data)[1]) == rows
        if name == "b.byf":
            with pytest.raises(f.Truncated):
                list(f.streamed(io.BytesIO(data[: len(data) // 2]))[1])
    for empty in (f.to_text(TYPED, []), f.to_binary(TYPED, [])):
        header, got = f.streamed(io.BytesIO(empty))
        assert header.text() == TYPED.text() and list(got) == []
    with pytest.raises(ValueError):
        f.streamed(io.BytesIO(b"neither"))


def test_whole_samples_by_tasks(spark, tmp_path):
    df = spark.createDataFrame([(s << 32 | k, s, float(k), 0.0, 0, 0, 1.5) for s in range(5) for k in range(20)], "id long, sample_id long, x float, y float, cflag long, pflag long, m float").repartition(7)
    h = model.Header().add("MA", ID="m", TY="f")
    written = f.write_samples(df, h, f"{tmp_path}/w", ".cyf").collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["cells"]) for r in written) == [(f"{s}.cyf", 20) for s in range(5)]
    back, header = f.read(spark, f"file://{tmp_path}/w/*.cyf")
    assert header.text() == h.text() and sorted(r["id"] for r in back.collect()) == sorted(r["id"] for r in df.collect())


def test_checks_and_replaced_columns(spark):
    from tesselum.operators import rows

    h = model.Header().add("HD", MP="1", UN="micron").add("MA", ID="m", TY="f")
    df = spark.createDataFrame([(1, 2.0, 3.0, 0, 0, 5.0), (2, 2.0, None, 0, 0, 5.0)], "id long, x double, y double, cflag long, pflag long, m float")
    assert rows.check(df.where("y is not null"), h).count() == 1
    with pytest.raises(Exception, match="lacks"):
        rows.check(df, h).collect()
    with pytest.raises(ValueError, match="no column m"):
        rows.check(df.drop("m"), h)
    new = spark.createDataFrame([(1, 7.0), (2, 8.0)], "key long, value double")
    assert [r["x"] for r in rows.replace_fixed(df, "x", new).orderBy("id").collect()] == [7.0, 8.0]
    with pytest.raises(Exception, match="size"):
        rows.replace_fixed(df, "x", new.limit(1)).collect()
    with pytest.raises(ValueError, match="none of"):
        rows.replace_fixed(df, "m", new)
