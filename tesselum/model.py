"""Cell tables: rows with id, sample_id, cell_id, x, y, cflag, pflag and data columns, and a header that describes them.

`id` packs the sample into its high and the cell into its low 32 bits. A header is an ordered list of tags, each a class
and KEY:VALUE fields; those of classes MA, CA and GA, in this order, define the data columns. It stays on the driver, beside the
DataFrame, so that changing it rewrites no data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIXED = ("id", "x", "y", "cflag", "pflag")

# The standard structure bits, the further region bits, the type codes and the tag classes.
CFLAG_BITS = {"Tumor": 0, "Mark": 1, "Margin": 2, "TumorManual": 3, "Tcell": 4, "TLS": 5, "MarginManual": 6, "Normal": 7, "NormalMargin": 8, "Artifact": 9, "BuildGraph": 21}
TYPES = {"i": "int", "I": "bigint", "l": "bigint", "L": "bigint", "f": "float", "d": "double", "Z": "string", "A": "int", "B": "array"}
CLASSES = ("HD", "SA", "IM", "RO", "MA", "CA", "GA", "FL", "PG")

TUMOR, MARK, MARGIN, TUMOR_MANUAL, TCELL, TLS = (1 << CFLAG_BITS[k] for k in ("Tumor", "Mark", "Margin", "TumorManual", "Tcell", "TLS"))
NORMAL, ARTIFACT, BUILD_GRAPH = (1 << CFLAG_BITS[k] for k in ("Normal", "Artifact", "BuildGraph"))


def pack(sample: Column, cell: Column) -> Column:
    return F.shiftleft(sample.cast("long"), 32).bitwiseOR(cell.cast("long").bitwiseAND(0xFFFFFFFF))


def sample_of(id_: Column) -> Column:
    return F.shiftrightunsigned(id_, 32)


def cell_of(id_: Column) -> Column:
    return id_.bitwiseAND(0xFFFFFFFF)


def escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n")


def unescape(value: str) -> str:
    out, i = [], 0
    while i < len(value):
        if value[i] == "\\" and i + 1 < len(value):
            out.append({"t": "\t", "n": "\n"}.get(value[i + 1], value[i + 1]))
            i += 2
        else:
            out.append(value[i])
            i += 1
    return "".join(out)


@dataclass
class Tag:
    kind: str
    fields: dict[str, str]

    @property
    def id(self) -> str:
        return self.fields.get("ID", "")

    def text(self) -> str:
        first = {"ID": self.fields["ID"]} if "ID" in self.fields else {}
        return "\t".join([f"@{self.kind}", *(f"{k}:{escape(str(v))}" for k, v in {**first, **self.fields}.items())])


@dataclass
class Header:
    tags: list[Tag] = field(default_factory=lambda: [Tag("HD", {"VN": "1.0"})])

    @classmethod
    def parse(cls, text: str) -> Header:
        tags = []
        for line in text.split("\n"):
            if line.startswith("@"):
                kind, *rest = line.split("\t")
                tags.append(Tag(kind[1:], {k: unescape(v) for k, _, v in (x.partition(":") for x in rest)}))
        return cls(sorted(tags, key=lambda t: t.kind != "HD") or [Tag("HD", {"VN": "1.0"})])

    def text(self) -> str:
        return "".join(t.text() + "\n" for t in self.tags)

    def of(self, *kinds: str) -> list[Tag]:
        return [t for k in kinds for t in self.tags if t.kind == k]

    @property
    def markers(self) -> list[str]:
        return [t.id for t in self.of("MA")]

    @property
    def data(self) -> list[Tag]:
        """The tags of the data columns, in record order."""
        return self.of("MA", "CA", "GA")

    def add(self, kind: str, **fields: str) -> Header:
        """A header with one more tag; a tag of the same class and ID is merged with it, HD always is."""
        if kind not in CLASSES:
            raise ValueError(f"no tag class {kind}")
        tags, done = [], False
        for t in self.tags:
            if t.kind == kind and (kind == "HD" or fields.get("ID") is not None and t.id == fields["ID"] and (kind != "FL" or t.fields.get("RG") == fields.get("RG"))):
                tags.append(Tag(kind, {**t.fields, **fields}))
                done = True
            else:
                tags.append(t)
        return Header(tags if done else [*tags, Tag(kind, dict(fields))])

    def without(self, keep) -> Header:
        return Header([t for t in self.tags if keep(t)])

    def renamed(self, names: dict[str, str]) -> Header:
        return Header([Tag(t.kind, {**t.fields, "ID": names[t.id]}) if t.kind in ("MA", "CA", "GA") and t.id in names else t for t in self.tags])

    def program(self, what: str) -> Header:
        chain = self.of("PG")
        more = {"PP": chain[-1].id} if chain else {}
        return self.add("PG", ID=str(len(chain) + 1), PN="tesselum", CL=what, **more)

    def standard_flags(self) -> Header:
        out = self
        for name, b in CFLAG_BITS.items():
            out = out.add("FL", ID=name, RG="cflag", BI=str(b))
        return out

    @property
    def microns(self) -> float:
        """Microns per unit of x and y."""
        hd = self.of("HD")[0].fields
        return float(hd["MP"]) if hd.get("UN") == "pixel" else 1.0

    def check(self) -> list[str]:
        """What a valid header lacks."""
        hd, out = self.of("HD")[0].fields, []
        try:
            if not float(hd.get("MP", "")) > 0:
                out.append("MP must be above 0")
        except ValueError:
            out.append("MP is missing or no number")
        if hd.get("UN") not in ("micron", "pixel"):
            out.append("UN must be micron or pixel")
        return out

    def select(self, df: DataFrame) -> DataFrame:
        """The fixed and the data columns of df, in record order."""
        return df.select(*FIXED, *[t.id for t in self.data])
