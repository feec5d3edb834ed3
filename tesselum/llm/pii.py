"""PII: detected entities get keyed surrogates of the same type and format.

One regular expression finds e-mail, IPv4 and IPv6 addresses, card, account, social-security and telephone numbers, secrets and titled
names in a text; the text is split at them and put together again with surrogates between the parts. In a text with titled names, bare
mentions of the same names between the entities are replaced too ("Dr. John Smith ... Smith's"). A surrogate is drawn from
SHA-256 of key, type, entity and attempt: letters for letters of the same script, digits for digits, hexadecimal for hexadecimal, card numbers
that pass or fail the Luhn test as the original does, account numbers of the same country with check digits as right or wrong as before, telephone
numbers of the same country code, names of the same script. What two mentions have in common decides, not their spelling: digits
without separators, an address in lower case, each part of a name by itself; so the same person, number or address has one surrogate
everywhere, in the mention's own format. A given name's gender isn't part of its identity: the titles of all texts vote on it, and where they are
silent or differ, its ending tells.

Before the rewrite the distinct entities of all texts are checked: of those that draw the same surrogate all but the first draw
again, as do those whose surrogate is itself an entity of the corpus, until no collision is left. Each redraw of a name, an e-mail
address, a secret or a hexadecimal string is longer by a syllable or a character, so their pools grow; other types keep their format. What the
rewrite must know of an entity beside itself, that it drew again or its gender by title, goes there as one literal, hashed into buckets, or by a join
where there are more than LITERALS such entities. All of it is DataFrame functions.

Edge cases: null texts stay null and count no entities; empty texts stay empty; repeated rows are rewritten alike; a table without
entities, or without rows, goes through unchanged; `n_entities` (bare mentions of names not counted) of the input is replaced, other columns pass
through. A word that is a name in its text is replaced wherever it stands there with a capital, also where it means something else ("Mr. May ... in May");
initials stay. No types: dates of birth, street addresses, names without any title in their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselum.llm.common import bind, cut, fresh, join_split, once, table

KEY = "tesselum-surrogates-1"
#: Entities of which more than themselves must be known, that go to the rewrite as a literal, at most: some 3 MB.
LITERALS = 50_000
BUCKET = 8
ATTEMPTS = 32
#: Redraws by which a surrogate grows, at most; a stream has 32 bytes at least.
GROWTH = 12

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "госпожа", "Госпожа")
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "господин", "Господин")
NEUTRAL = ("Dr", "Prof", "Professor", "доктор", "Доктор")
_TITLES = "|".join(sorted(FEMALE + MALE + NEUTRAL, key=lambda t: -len(t)))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
#: A name's word: Jean-Luc, O'Brien, McDonald, DOE; a genitive 's is not of it.
NAME = r"(?:\p{Lu}['’]\p{L}{2,}+|\p{Lu}\p{L}++)(?:['’]\p{Lu}\p{L}++|-\p{L}++)*+"
_INITIAL = r"\p{Lu}\."
#: Types in the order in which they are tried where two could begin at the same place.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\p{L}0-9._%+-])[._%+-]*+[\p{L}0-9][\p{L}0-9._%+-]*+@(?:[\p{L}0-9-]++\.)+\p{L}{2,24}"),
    ("secret", r"(?<![A-Za-z0-9_])(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key))[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[A-Za-z0-9_+/.-]{8,}+"),
    ("ip", rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"),
    ("ip6", rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{{3,4}}:(?:(?:{_H}:){{0,5}}(?::{_H}){{1,6}}|(?:{_H}:){{0,6}}:))(?![\p{{L}}\p{{N}}:])"),
    ("iban", r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])"),
    ("card", r"(?<![0-9+])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9]|[.-][0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])|(?<![0-9-])(?<![0-9] )[2-9][0-9]{2} [0-9]{3} [0-9]{4}(?![0-9-]| [0-9])"),
    ("hex", r"(?<![A-Za-z0-9_])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9_])"),
    ("name", rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:(?:{_INITIAL} ?){{1,3}})?{NAME}(?![^ \t\n\r@]*@)(?: (?:{_INITIAL} )?{NAME}(?![^ \t\n\r@]*@)){{0,2}}"),
)
ENTITY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: One of these a text with an entity holds; all begin with what is rare or quickly scanned, and look back from there.
_HINTS = ("[0-9@]", r"[=:](?<=(?i:token|secret|passw(?:or)?d|key)[\"']?[ \t]{0,4}[=:])", rf" (?=\p{{Lu}})(?<=(?:{_TITLES})\.? )")
#: A word that can be a bare mention of a name.
_MENTION = rf"(?<![\p{{L}}\p{{N}}'’-]){NAME}"
_SECRET = r"(?s)^(.*?[=:][ \t]*[\"']?)(.*)$"
_SYLLABLES = {"latin": ("bdfghklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστφχ", "αειο")}
#: Ends of names by gender: f, m, unknown.
_ENDS = {"latin": ("na", "ro", "nd"), "cyrillic": ("на", "р", "нов"), "greek": ("να", "νος", "νης")}
#: Letters to draw from for a letter of a script; of any other, Latin ones.
_LETTERS = (
    ("Latin", "abcdefghijklmnopqrstuvwxyz"),
    ("Cyrillic", "абвгдежзиклмнопрстуфхцчшэюя"),
    ("Greek", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("Hebrew", "אבגדהוזחטיכלמנסעפצקרשת"),
    ("Arabic", "ابتثجحدرزسشصطعغفقكلمنهوي"),
    ("Han", "山水日月木火土金人口心手文天田石"),
    ("Hiragana", "あいうえおかきくけこさしすせそ"),
    ("Katakana", "アイウエオカキクケコサシスセソ"),
    ("Hangul", "가나다라마바사아자차카타파하"),
    ("Devanagari", "कखगघचछजझटठडढतथदधनपफबभम"),
    ("Thai", "กขคงจชซดตทนบปผพมยรลวสหอ"),
)
# Telephone country codes of one and of two digits; all others have three.
_CODES = r"^(?:(1|7)|(2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]))"


def kind_of(e: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed(PATTERNS[:-1]):
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _stream(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """Hexadecimal digits, two and more for each character of norm."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), norm)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(norm) / 16).cast("int")), lambda i: F.sha2(F.concat_ws("|", seed, i.cast("string")), 256)), "")


def _byte(stream: Column, i) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _pick(chars: str, n: Column) -> Column:
    return F.substring(F.lit(chars), F.pmod(n, F.lit(len(chars))) + 1, F.lit(1))


def _longer(chars: str, stream: Column, attempt: Column) -> Column:
    """A drawn character for each redraw."""
    drawn = F.transform(F.sequence(F.lit(1), F.least(attempt, F.lit(GROWTH))), lambda i: _pick(chars, _byte(stream, 12 + i)))
    return F.when(attempt > 0, F.array_join(drawn, "")).otherwise(F.lit(""))


def _mapped(norm: Column, stream: Column) -> Column:
    """norm with letters for letters of the same script and digits for digits; a hexadecimal string stays one."""

    def one(c: Column, i: Column, hexadecimal: Column) -> Column:
        other = F.when(c.rlike("\\p{L}"), F.lit(_LETTERS[0][1])).otherwise(c)
        for script, letters in reversed(_LETTERS[1:]):
            other = F.when(c.rlike(f"[\\p{{L}}&&\\p{{Is{script}}}]"), F.lit(letters)).otherwise(other)
        chars = F.when(hexadecimal, F.lit("0123456789abcdef")).when(c.rlike("[0-9]"), F.lit("0123456789")).when(c.rlike("[a-z]"), F.lit(_LETTERS[0][1])).when(c.rlike("[A-Z]"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(other)
        return bind(chars, lambda x: F.substring(x, F.pmod(_byte(stream, i), F.length(x)) + 1, F.lit(1)))

    return bind(norm.rlike("^(?=.*[a-f])[0-9a-f]{8,}$"), lambda h: F.array_join(F.transform(F.split(norm, ""), lambda c, i: one(c, i, h)), ""))


def _luhn(digits: Column) -> Column:
    """The sum that a valid number has in tens."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: bind(c.cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(norm: Column, stream: Column) -> Column:
    """The first digit kept, the others drawn, the last such that the Luhn test comes out as before."""
    head = F.concat(F.substring(norm, 1, 1), F.array_join(F.transform(F.sequence(F.lit(2), F.length(norm) - 1), lambda i: _pick("0123456789", _byte(stream, i))), ""))
    fits = lambda h: F.pmod(10 - F.pmod(_luhn(F.concat(h, F.lit("0"))), F.lit(10)), F.lit(10))
    off = F.when(F.pmod(_luhn(norm), F.lit(10)) == 0, 0).otherwise(1 + F.pmod(_byte(stream, F.lit(1)), F.lit(9)))
    return bind(head, lambda h: F.concat(h, F.pmod(fits(h) + off, F.lit(10)).cast("string")))


def _drawn(stream: Column, n: Column, at: int = 0) -> Column:
    """n digits."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: _pick("0123456789", _byte(stream, i + at))), "")).otherwise(F.lit(""))


def _phone(norm: Column, stream: Column) -> Column:
    """The country code kept, the other digits drawn."""
    code = F.least(F.when(norm.rlike("^[17]"), 1).when(norm.rlike(_CODES), 2).otherwise(3), F.length(norm))
    return F.concat(F.substring(norm, F.lit(1), code), _drawn(stream, F.length(norm) - code))


def _mod97(chars: Column) -> Column:
    """Of the number that digits, and letters as 10 to 35, spell."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return F.aggregate(F.split(chars, ""), F.lit(0), step)


def _iban(norm: Column, drawn: Column, stream: Column) -> Column:
    """The country kept, the account drawn, check digits that are as right or wrong as before."""
    country, account = F.substring(norm, 1, 2), F.substring(norm, F.lit(5), F.length(norm))
    off = F.when(_mod97(F.concat(account, F.substring(norm, 1, 4))) == 1, 0).otherwise(1 + F.pmod(_byte(stream, F.lit(0)), F.lit(96)))

    def whole(a: Column) -> Column:
        right = 98 - _mod97(F.concat(a, country, F.lit("00")))  # 2 to 98
        return F.concat(country, F.lpad((2 + F.pmod(right - 2 + off, F.lit(97))).cast("string"), 2, "0"), a)

    return whole(drawn)


def _ip(norm: Column, stream: Column) -> Column:
    o = lambda i: (1 + F.pmod(_byte(stream, F.lit(i)), F.lit(254))).cast("string")
    first = (11 + F.pmod(_byte(stream, F.lit(4)), F.lit(100))).cast("string")
    return (
        F.when(norm.startswith("10."), F.concat_ws(".", F.lit("10"), o(1), o(2), o(3)))
        .when(norm.startswith("192.168."), F.concat_ws(".", F.lit("192.168"), o(2), o(3)))
        .when(norm.startswith("127."), F.concat_ws(".", F.lit("127"), o(1), o(2), o(3)))
        .otherwise(F.concat_ws(".", first, o(1), o(2), o(3)))
    )


def _groups(e: Column) -> Column:
    """The eight groups of an IPv6 address, four digits each, joined by colons."""
    pad = lambda x: F.transform(F.filter(F.split(x, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    low = F.lower(e)

    def filled(ends: Column) -> Column:
        zeros = F.array_repeat(F.lit("0000"), F.greatest(8 - F.size(ends["a"]) - F.size(ends["b"]), F.lit(0)))
        return F.array_join(F.concat(ends["a"], zeros, ends["b"]), ":")

    return bind(F.struct(pad(F.substring_index(low, "::", 1)).alias("a"), F.when(low.contains("::"), pad(F.substring_index(low, "::", -1))).otherwise(F.array().cast("array<string>")).alias("b")), filled)


def _ip6(norm: Column, stream: Column) -> Column:
    """The first group and empty groups kept, the others drawn and not empty."""

    def one(g: Column, i: Column) -> Column:
        b = 4 * i
        hexa = lambda k: _pick("0123456789abcdef", _byte(stream, b + k))
        return F.when((i == 0) | (g == "0000"), g).otherwise(F.concat(_pick("123456789abcdef", _byte(stream, b)), hexa(1), hexa(2), hexa(3)))

    return F.array_join(F.transform(F.split(norm, ":"), one), ":")


def _ip6_like(e: Column, made: Column) -> Column:
    """made (eight groups) with the double colon where the mention has it, in its case."""

    def short(g: Column) -> Column:
        bare = F.transform(g, lambda x: F.regexp_replace(x, "^0{1,3}", ""))
        sides = [F.filter(F.split(F.substring_index(e, "::", k), ":"), lambda x: x != "") for k in (1, -1)]
        left, right = F.slice(bare, F.lit(1), F.size(sides[0])), F.when(F.size(sides[1]) > 0, F.slice(bare, 9 - F.size(sides[1]), F.size(sides[1]))).otherwise(F.array().cast("array<string>"))
        return F.when(e.contains("::"), F.concat(F.array_join(left, ":"), F.lit("::"), F.array_join(right, ":"))).otherwise(F.array_join(bare, ":"))

    return bind(bind(F.split(made, ":"), short), lambda x: F.when(e.rlike("[A-F]") & ~e.rlike("[a-f]"), F.upper(x)).otherwise(x))


def _email(norm: Column, drawn: Column, more: Column, key: str) -> Column:
    """The local part drawn, the domain's labels mapped by themselves, so that addresses at one domain stay so; under a reserved name."""
    domain = F.substring_index(norm, "@", -1)
    labels = F.regexp_replace(F.regexp_replace(domain, r"\.\p{L}+$", ""), r"(^|\.)example$", "")
    last = F.substring_index(domain, ".", -1)
    end = F.when(last.isin("com", "net", "org"), F.concat(F.lit("example."), last)).otherwise(F.lit("example.com"))
    sub = F.when(labels == "", F.lit("")).otherwise(F.concat(_mapped(labels, _stream(F.lit("domain"), domain, F.lit(0), key)), F.lit(".")))
    return F.concat(drawn, more, F.lit("@"), sub, end)


def _name(norm: Column, stream: Column, attempt: Column, gender: Column) -> Column:
    """Of each part between hyphens two or three syllables in the name's script, one more for each redraw, and an end of its gender's; O' stays."""
    by_end = F.when(norm.rlike("(?:a|а|я|α)$"), F.lit("f")).when(norm.rlike("(?:ов|ев|ин|ий|ος|ης)$"), F.lit("m")).otherwise(F.lit("u"))
    scripts = list(_SYLLABLES)
    of = lambda values: F.when(norm.rlike(r"\p{IsCyrillic}"), values[1]).when(norm.rlike(r"\p{IsGreek}"), values[2]).otherwise(values[0])
    chosen = F.struct(*[of([_SYLLABLES[s][k] for s in scripts]).alias(n) for k, n in enumerate("cv")], of(["|".join(_ENDS[s]) for s in scripts]).alias("ends"), F.coalesce(gender, by_end).alias("g"))

    def made(x: Column) -> Column:
        end = F.split_part(x["ends"], F.lit("|"), F.when(x["g"] == "f", 1).when(x["g"] == "m", 2).otherwise(3))
        end = F.when(norm.rlike("(?:ова|ева|ина)$"), "ова").when(norm.rlike("(?:ов|ев|ин|ий)$"), "ов").otherwise(end)
        pick = lambda chars, n: F.substring(chars, F.pmod(n, F.length(chars)) + 1, F.lit(1))

        def part(_: Column, j: Column) -> Column:
            at = lambda i: _byte(stream, F.pmod(i + 9 * j, F.lit(32)))
            n = 2 + F.pmod(at(F.lit(0)), F.lit(2)) + F.least(attempt, F.lit(GROWTH))
            return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(pick(x["c"], at(2 * i)), pick(x["v"], at(2 * i + 1)))), ""), end)

        return F.concat(F.regexp_extract(norm, "^(\\p{L}['’])?", 0), F.array_join(F.transform(F.split(norm, "-"), part), "-"))

    return bind(chosen, made)


def surrogate(kind: Column, norm: Column, attempt: Column, gender: Column, key: str = KEY, named: bool = False) -> Column:
    """The surrogate of a normalised entity. gender: of a name, f or m where titles tell it, else null; named: all are names."""

    if named:
        return bind(_stream(F.lit("name"), norm, attempt, key), lambda s: _name(norm, s, attempt, gender))
    body = F.when(kind == "email", F.substring_index(norm, "@", 1)).when(kind == "iban", F.substring(norm, F.lit(5), F.length(norm))).otherwise(norm)

    def drawn(s: Column) -> Column:
        plain = F.when(kind.isin("email", "iban", "secret", "hex", "ssn"), _mapped(body, s))
        more = F.when(kind == "email", _longer("abcdefghijklmnopqrstuvwxyz", s, attempt)).otherwise(_longer("0123456789abcdef", s, attempt))
        return bind(F.struct(plain.alias("m"), more.alias("more")), lambda x: made(s, x["m"], x["more"]))

    def made(s: Column, m: Column, more: Column) -> Column:
        return (
            F.when(kind == "email", _email(norm, m, more, key))
            .when(kind == "ip", _ip(norm, s))
            .when(kind == "ip6", _ip6(norm, s))
            .when(kind == "card", _card(norm, s))
            .when(kind == "phone", _phone(norm, s))
            .when(kind == "iban", _iban(norm, m, s))
            .when(kind == "name", _name(norm, s, attempt, gender))
            .when(kind == "initial", norm)
            .when(kind.isin("secret", "hex"), F.concat(m, more))
            .otherwise(m)
        )

    return bind(_stream(kind, norm, attempt, key), drawn)


def parts(e: Column) -> Column:
    """The surrogate-bearing parts of an entity: array<struct<kind, norm, gender>>; one, or a name's words. gender: the title's, of a given name."""
    none = F.lit(None).cast("string")
    one = lambda k, n, g=none: F.struct(k.alias("kind"), n.alias("norm"), g.alias("gender"))

    def of(kind: Column) -> Column:
        norm = (
            F.when(kind == "email", F.regexp_replace(F.lower(e), "^[._%+-]+", ""))
            .when(kind == "secret", F.regexp_extract(e, _SECRET, 2))
            # numbers without a country code are of the North American plan
            .when(kind == "phone", F.when(e.startswith("+"), _digits(e)).otherwise(F.concat(F.lit("1"), _digits(e))))
            .when(kind.isin("card", "ssn"), _digits(e))
            .when(kind == "iban", F.regexp_replace(e, " ", ""))
            .when(kind == "ip6", _groups(e))
            .when(kind == "hex", F.lower(e))
            .otherwise(e)
        )
        return F.when(kind == "name", bind(F.split(e, " "), names)).otherwise(F.array(one(kind, norm)))

    def names(w: Column) -> Column:
        title = F.regexp_replace(F.get(w, F.lit(0)), r"\.$", "")
        gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m")
        words = F.slice(w, F.lit(2), F.size(w))

        def word(x: Column, i: Column) -> Column:
            return F.when(x.rlike(rf"^(?:{_INITIAL})+$"), one(F.lit("initial"), x)).otherwise(one(F.lit("name"), F.lower(x), F.when((i == 0) & (F.size(w) > 2), gender)))

        return F.transform(words, word)

    return bind(kind_of(e), of)


def _named(word: Column, made: Column) -> Column:
    """A name's surrogate in the mention's case: capitals at the beginning of each part, or all capitals."""
    parts_ = F.transform(F.split(made, "(?<=['’-])"), lambda x: F.initcap(x))
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(made)).otherwise(F.array_join(parts_, ""))


def _dressed(e: Column, kind: Column, made: Column) -> Column:
    """Surrogates (array<string>, one per part) in the mention's own format."""

    def refill(pattern: str) -> Column:
        # of a longer surrogate (that has the country code, which the mention hasn't) the end
        d = F.get(made, F.lit(0))
        skip = F.length(d) - F.length(F.regexp_replace(e, f"(?!{pattern}).", ""))
        start = F.struct(F.lit("").alias("s"), skip.alias("i"))
        step = lambda a, c: F.when(c.rlike(pattern), F.struct(F.concat(a["s"], F.substring(d, a["i"] + 1, F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))
        return F.aggregate(F.split(e, ""), start, step)["s"]

    first = F.get(made, F.lit(0))
    return (
        F.when(kind.isin("card", "phone", "ssn"), refill("[0-9]"))
        .when(kind == "iban", refill("[A-Z0-9]"))
        .when(kind == "ip6", _ip6_like(e, first))
        .when(kind == "secret", F.concat(F.regexp_extract(e, _SECRET, 1), first))
        .when(kind == "name", bind(F.split(e, " "), lambda w: F.array_join(F.concat(F.slice(w, 1, 1), F.transform(made, lambda m, j: F.when(F.get(w, j + 1).rlike(rf"^(?:{_INITIAL})+$"), m).otherwise(_named(F.get(w, j + 1), m)))), " ")))
        .when(kind == "email", F.concat(F.regexp_extract(e, "^[._%+-]*", 0), F.when(F.upper(e) == e, F.upper(first)).otherwise(first)))
        .when(F.upper(e) == e, F.upper(first))
        .otherwise(first)
    )


def _hinted(text: Column) -> Column:
    return text.rlike(_HINTS[0]) | text.rlike(_HINTS[1]) | text.rlike(_HINTS[2])


def _found(text: Column) -> Column:
    return F.when(_hinted(text), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct (kind, norm, gender) of all texts. gender: of names, f or m where all titles before it as a given name agree."""
    each = docs.where(_hinted(F.col(text))).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))).alias("e"))
    each = each.groupBy("e").agg(F.lit(1).alias("one")).select(F.explode(parts(F.col("e"))).alias("p")).where("p.kind <> 'initial'")
    votes = each.groupBy("p.kind", "p.norm").agg(F.min("p.gender").alias("low"), F.max("p.gender").alias("high"))
    return votes.select("kind", "norm", F.when(F.col("low") == F.col("high"), F.col("low")).alias("gender"))


def notes(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, attempt, gender) of the entities that draw more than once, so that no two have the same surrogate and none has an entity's, or
    whose gender titles tell."""
    now = cut(found.withColumn("attempt", F.lit(0)))
    known = now.select(F.col("kind"), F.col("norm").alias("made")).distinct()
    for _ in range(ATTEMPTS):
        drawn = now.select("kind", "norm", "attempt", once(surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("gender"), key)).alias("made"))
        drawn = cut(drawn)
        first = drawn.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        clash = drawn.join(first, ["kind", "made"]).where(F.struct("attempt", "norm") != F.col("first")).select("kind", "norm")
        again = cut(clash.union(drawn.join(known, ["kind", "made"], "left_semi").select("kind", "norm")).distinct())
        if again.isEmpty():
            return now.where("attempt > 0 or gender is not null").select("kind", "norm", "attempt", "gender")
        now = cut(now.join(again.withColumn("redo", F.lit(1)), ["kind", "norm"], "left").select("kind", "norm", "gender", (F.col("attempt") + F.coalesce("redo", F.lit(0))).alias("attempt")), forget=True)
    raise RuntimeError(f"surrogates still collide after {ATTEMPTS} draws")


def _literal(noted: DataFrame, n: int):
    """p -> struct<attempt, gender> from a literal: lines "kind|norm attempt gender" in hashed buckets. Norms have no tab or line feed."""
    many = max(1, n // BUCKET)
    name = F.concat_ws("|", "kind", "norm")
    rows = noted.select(F.pmod(F.xxhash64(name), F.lit(many)).alias("b"), name.alias("k"), "attempt", F.coalesce("gender", F.lit("")).alias("g")).collect()  # LITERALS at most
    buckets: list[list[str]] = [[] for _ in range(many)]
    for r in rows:
        buckets[r["b"]].append(f"{r['k']}\t{r['attempt']}\t{r['g']}\n")
    whole = F.split(F.lit("\f".join("".join(b) for b in buckets)), "\f")  # folded into an array once

    def look(p: Column) -> Column:
        k = F.concat_ws("|", p["kind"], p["norm"])
        line = F.filter(F.split(F.get(whole, F.pmod(F.xxhash64(k), F.lit(many)).cast("int")), "\n"), lambda x: F.substring_index(x, "\t", 1) == k)
        return bind(F.split(F.get(line, F.lit(0)), "\t"), lambda f: F.struct(F.coalesce(F.get(f, F.lit(1)).cast("int"), F.lit(0)).alias("attempt"), F.nullif(F.get(f, F.lit(2)), F.lit("")).alias("gender")))

    return look


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with surrogates in their texts, and n_entities (long)."""
    noted = cut(notes(entities(docs, text), key))
    n = noted.count()
    docs = docs.drop("n_entities")
    found, made = fresh(docs, "_found", "_notes")
    out = docs.withColumn(found, once(_found(F.col(text))))
    if not n:
        look = lambda p: F.struct(F.lit(0).alias("attempt"), F.lit(None).cast("string").alias("gender"))
    elif n <= LITERALS:
        look = _literal(noted, n)
    else:
        (row,) = fresh(docs, "_row")
        out = cut(out.withColumn(row, F.monotonically_increasing_id()))
        each = out.select(row, F.explode(found).alias("e")).select(row, F.explode(parts(F.col("e"))).alias("p")).select(row, F.concat_ws("|", "p.kind", "p.norm").alias("k")).distinct()
        each = cut(each)
        known = noted.select(F.concat_ws("|", "kind", "norm").alias("k"), "attempt", "gender")
        per = join_split(each, known, "k", "inner").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("attempt", "gender")))).alias(made))
        out = out.join(per, row, "left")

        def look(p: Column) -> Column:
            hit = F.col(made)[F.concat_ws("|", p["kind"], p["norm"])]
            return F.struct(F.coalesce(hit["attempt"], F.lit(0)).alias("attempt"), hit["gender"].alias("gender"))

    def drawn(p: Column, named: bool = False) -> Column:
        return bind(look(p), lambda x: surrogate(p["kind"], p["norm"], x["attempt"], x["gender"], key, **({"named": True} if named else {})))

    def rewritten(e: Column) -> Column:
        return _dressed(e, kind_of(e), F.transform(parts(e), lambda p: drawn(p)))

    names = F.flatten(F.transform(F.filter(found, lambda e: kind_of(e) == "name"), lambda e: F.transform(F.filter(parts(e), lambda p: p["kind"] == "name"), lambda p: p["norm"])))

    def between(part: Column, known: Column) -> Column:
        """What stands between entities, with surrogates for bare mentions of known names."""

        def word(w: Column) -> Column:
            p = F.struct(F.lit("name").alias("kind"), F.lower(w).alias("norm"))
            return F.when(F.array_contains(known, F.lower(w)), _named(w, drawn(p, True))).otherwise(w)

        mended = bind(F.transform(F.regexp_extract_all(part, F.lit(_MENTION), F.lit(0)), word), lambda m: F.array_join(F.transform(F.split(part, _MENTION, -1), lambda x, i: F.concat(x, F.coalesce(F.get(m, i), F.lit("")))), ""))
        return F.when((F.size(known) > 0) & part.rlike(_MENTION), mended).otherwise(part)

    whole = bind(
        F.struct(F.transform(found, rewritten).alias("s"), F.array_distinct(names).alias("known")),
        lambda v: F.array_join(F.transform(F.split(F.col(text), ENTITY, -1), lambda part, i: F.concat(between(part, v["known"]), F.coalesce(F.get(v["s"], i), F.lit("")))), ""),
    )
    out = out.withColumns({text: F.when(F.size(found) > 0, whole).otherwise(F.col(text)), "n_entities": F.coalesce(F.size(found), F.lit(0)).cast("long")})
    return out.select(*docs.columns, "n_entities")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
