"""Text functions, Column to Column. Regular expressions are written as for Python and translated for the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dims

#: Word characters, white space and digits as Python's Unicode patterns have them.
W, S = r"[\p{L}\p{N}_]", r"[\s\x1c-\x1f\x85\p{Z}]"
_OPEN, _GROUP, _CLOSE = "\u0001", "\u0002", "\u0003"


def jvm(pattern: str, flags: str = "imdu") -> str:
    """A Python pattern for java.util.regex: Unicode classes and word boundaries, and only a line feed ends a line."""
    edge = f"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"
    if pattern.startswith(r"\b"):  # a word character follows each leading boundary of ours
        pattern = f"(?<!{W})" + pattern[2:]
    for a, b in ((r"\s", S), (r"\w", W), (r"\d", r"\p{Nd}"), (r"\b", edge)):
        pattern = pattern.replace(a, b)
    return (f"(?{flags})" if flags else "") + pattern


def jvm_ascii(pattern: str, flags: str = "imd") -> str:
    """A Python pattern for java.util.regex and texts of ASCII alone, where it matches as jvm()'s does, in less time."""
    for a, b in ((r"\s", r"[\t-\r\x1c-\x20]"), (r"\w", "[A-Za-z0-9_]"), (r"\d", "[0-9]")):
        pattern = pattern.replace(a, b)
    return (f"(?{flags})" if flags else "") + pattern


def ascii_only(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def replaced(text: Column, pattern: str, by: str, flags: str = "imd") -> Column:
    """text with each match of a Python pattern replaced."""
    unicode = flags.replace("i", "iu")
    return F.when(ascii_only(text), F.regexp_replace(text, F.lit(jvm_ascii(pattern, flags)), F.lit(by))).otherwise(F.regexp_replace(text, F.lit(jvm(pattern, unicode)), F.lit(by)))


def let(value: Column, f) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def keep_some(df: DataFrame, name: str, some: Column) -> DataFrame:
    """df with the items of some (an array, null or empty where the row goes) as name. A filter on a computed column is pushed
    below it and computes it again for each time it is named; an array is computed once."""
    return df.select(*[c for c in df.columns if c != name], F.explode(some).alias(name))


#: The characters that S stands for.
_BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANKS))


def collapse(c: Column) -> Column:
    # a lone space stays as it is
    return F.regexp_replace(c, f"(?:[{S}&&[^ ]]| (?={S})){S}*", " ")


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def unmarked(c: Column) -> Column:
    """A line without markup and outer blanks."""
    bare = strip(c)
    return F.when(bare.contains("<"), strip(F.regexp_replace(bare, "</?[a-zA-Z][^>]{0,30}>", ""))).otherwise(bare)


def noise(t: Column) -> Column:
    """Whether an unmarked() line has too few letters."""
    n, alpha = F.length(t), letters(t)
    return (n == 0) | ((n <= 2) & (alpha < n)) | ((n > 4) & (alpha / n < 0.25))


def tidy(t: Column) -> Column:
    """An unmarked() line without runs of marks and spacing faults."""
    t = F.regexp_replace(t, r"([^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}])\1{2,}", "$1$1")
    t = F.regexp_replace(t, f"{S}+([,.:;!?)])", "$1")
    t = F.regexp_replace(t, rf"(\(){S}+", "$1")
    return F.regexp_replace(t, " {2,}", " ")


def clean_line(c: Column) -> Column:
    """The line without markup and spacing faults; null where it is noise. Takes NFKC text."""
    return let(unmarked(c), lambda t: F.when(~noise(t), tidy(t)))


def clean_text(c: Column) -> Column:
    """All lines cleaned; a run of dropped lines leaves one blank line, none at the start or end."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.coalesce(clean_line(x), F.lit("")))
    kept = F.filter(lines, lambda x, i: (x != "") | ((i > 0) & (F.get(lines, i - 1) != "")))
    return strip(F.array_join(kept, "\n"))


def reliable(c: Column) -> Column:
    """Whether digital text can be used as it is, or the page needs OCR."""
    visible = F.regexp_replace(c, S, "")
    plain = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    ok = (F.length(c) >= 25) & ~c.contains("(cid:") & (letters(c) >= 20) & (plain / F.nullif(F.length(visible), F.lit(0)) >= 0.55)
    return F.coalesce(ok, F.lit(False))


def normal_value(key: Column, value: Column) -> Column:
    plain = collapse(F.btrim(strip(value), F.lit(".,;:")))
    return let(plain, lambda v: _normal_value(key, v))


def _normal_value(key: Column, v: Column) -> Column:
    first = F.lower(F.left(strip(v), F.lit(1)))
    name = F.when(v.rlike(r"^[A-Za-z.\-' ]+\z"), F.initcap(F.trim(v))).otherwise(v)
    gender = F.when(first == "m", "Male").when(first == "f", "Female").otherwise(v)
    return F.when(key.isin(dims.NAMES), name).when(key == "total_amount", F.replace(v, F.lit(","), F.lit(""))).when(key == "gender", gender).otherwise(v)


def normal_label(c: Column) -> Column:
    return collapse(strip(F.rtrim(F.lower(strip(c)), F.lit(":-."))))


def snake(c: Column) -> Column:
    s = F.regexp_replace(normal_label(c), r"[^a-z0-9\x{0900}-\x{097F}]+", "_")
    return F.coalesce(F.nullif(F.btrim(s, F.lit("_")), F.lit("")), F.lit("field"))


def dedup_value(c: Column) -> Column:
    return F.lower(F.rtrim(strip(c), F.lit(_BLANKS + ".,;:-")))


def label_like(c: Column) -> Column:
    t = strip(c)
    return F.length(t).between(2, 60) & ~t.rlike(rf"^(?:{S}|[\p{{Nd}}\-/.,:])+\z") & ~F.lower(t).isin(dims.STOP_LABELS) & ((F.length(t) < 17) | (F.size(F.split(t, f"{S}+")) <= 8))


def value_like(c: Column) -> Column:
    t = strip(c)
    return ~t.endswith(":") & ~t.endswith(":-") & t.rlike(rf"[^{S[1:-1]}\-.:_;,][{S[1:-1]}\-.:_;,]*[^{S[1:-1]}\-.:_;,]")


def ascii_digits(c: Column) -> Column:
    return F.when(ascii_only(c), c).otherwise(F.translate(c, "०१२३४५६७८९", "0123456789"))


def parse_date(c: Column) -> Column:
    """The first of the accepted formats with a year of four digits that gives a date."""
    t = ascii_digits(strip(c))
    formats = [(r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy")]
    named = F.regexp_extract(t, r"^(\d{1,2})[- ]([A-Za-z]+)[- ](\d{4})$", 2)
    month = F.element_at(_months(), F.lower(named))
    ymd = F.concat_ws("-", F.regexp_extract(t, r"(\d{4})$", 1), month.cast("string"), F.regexp_extract(t, r"^(\d{1,2})", 1))
    tries = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in formats]
    # an abbreviated or full month; a blank only before a full one
    full = F.length(named) > 3
    tries.append(F.when((named != "") & (~t.contains(" ") | full | (F.lower(named) == "may")) & (F.lower(named) != "sept"), F.try_to_timestamp(ymd, F.lit("yyyy-M-d"))))
    tries.append(F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(t, F.lit("yyyy-M-d"))))
    return F.coalesce(*tries).cast("date")


def _months() -> Column:
    return F.create_map(*[F.lit(x) for pair in dims.MONTHS.items() for x in pair])


def iso_date(match: Column, kind: int, as_of_year: int) -> Column:
    """YYYY-MM-DD of a match of dims.DATES[kind]; null if there is no such day, or one before 1900 or 5 years ahead."""
    pattern = jvm(dims.DATES[kind].replace(r"\b", ""))
    parts = lambda t: F.struct(*[F.regexp_extract(t, pattern, i + 1).alias(n) for i, n in enumerate("cba" if kind == 2 else "abc")])

    def numbers(p: Column) -> Column:
        month = F.element_at(_months(), F.lower(p["b"])) if kind == 1 else p["b"].try_cast("int")
        return F.struct(p["a"].alias("day"), month.alias("m"), p["c"].try_cast("int").alias("y"))

    def dated(p: Column) -> Column:
        y = p["y"]
        y = F.when(y < 50, y + 2000).when(y < 100, y + 1900).otherwise(y) if kind != 2 else y
        return let(y, lambda y: F.when(p["m"].isNotNull() & y.between(1900, as_of_year + 5), F.date_format(F.try_to_timestamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), p["m"].cast("string"), p["day"]), F.lit("yyyy-M-d")), "yyyy-MM-dd")))

    # bound step by step, since in functions over arrays each use of a column computes it again
    return let(ascii_digits(match), lambda t: let(parts(t), lambda p: let(numbers(p), dated)))


#: Items that one fold adds up: a fold copies its state at each step, so the state must stay small.
_GROUP_SIZE = 256
#: Characters in a block: see blocks().
BLOCK = 512


def running(numbers: Column, add=lambda a, b: a + b) -> Column:
    """array<int>: for each number the sum of those before it, from 0. Groups of numbers are added up, then the sums of the
    groups: linear up to millions of numbers. add: another operation, such as F.greatest."""

    def few(xs: Column, base: Column) -> Column:
        step = lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(xs, F.struct(base.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s["out"])

    size = F.lit(_GROUP_SIZE)
    group = lambda g: F.slice(numbers, g * size + 1, size)
    nth = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / size).cast("int"))
    sums = F.transform(nth, lambda g: F.aggregate(group(g), F.lit(0), lambda a, x: add(a, x)))
    many = let(few(sums, F.lit(0)), lambda bases: F.flatten(F.transform(nth, lambda g: few(group(g), F.get(bases, g)))))
    return F.when(F.size(numbers) <= size, few(numbers, F.lit(0))).when(F.size(numbers) > size, many).otherwise(F.array().cast("array<int>"))


def blocks(text: Column) -> Column:
    """The text in pieces of BLOCK characters, the last one shorter, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(held: Column, start: Column, n: Column) -> Column:
    """n characters from start (counted from 0) of a text in blocks(), in time that depends on n alone."""
    first = F.floor(start / BLOCK).cast("int")
    some = F.slice(held, first + 1, F.floor((n + BLOCK - 1) / BLOCK).cast("int") + 1)
    return F.substr(F.array_join(some, ""), start - first * BLOCK + 1, F.greatest(n, F.lit(0)))


def place_of(starts: Column, at: Column) -> Column:
    """The place in starts (ascending) of the last one up to at, 0 if there is none: a binary search of up to 2**24 places,
    in as many steps as their number has binary digits."""
    digits = F.least(F.length(F.bin(F.size(starts))), F.lit(24))
    steps = F.slice(F.array(*[F.lit(1 << k) for k in range(23, -1, -1)]), F.lit(25) - digits, digits)
    return F.aggregate(steps, F.lit(0), lambda i, w: F.when((i + w < F.size(starts)) & (F.get(starts, i + w) <= at), i + w).otherwise(i))


def plain_text(text: Column) -> Column:
    """The text as spans() wants it: U+0001 to U+0003 become U+0004."""
    some = text.contains(_OPEN) | text.contains(_GROUP) | text.contains(_CLOSE)
    return F.when(some, F.translate(text, _OPEN + _GROUP + _CLOSE, "\u0004" * 3)).otherwise(text)


def folded(text: Column) -> Column:
    """Lower case in which a word is found wherever a pattern that ignores case finds it."""
    return F.when(ascii_only(text), F.lower(text)).otherwise(F.lower(F.translate(text, "\u017f\u212a\u0130\u0131", "skii")))


def marked(text: Column, pattern: str) -> Column:
    """A plain_text() with each match of the pattern, and its group 1 again, between marks."""
    return replaced(text, pattern, f"{_OPEN}$0{_GROUP}$1{_CLOSE}")


def has_marks(text: Column) -> Column:
    """Whether what is marked() has a match."""
    return text.contains(_OPEN)


def located(text: Column) -> Column:
    """array<struct<start,end,whole,value>> of what is marked(): code points, end exclusive; value is group 1.

    The lengths of the pieces between marks give the offsets, in time linear in the text. An expensive expression to
    plan: where many patterns run, one transform over an array of marked texts plans it once.
    """
    # text, match, group, text, match, group, ..., text; groups count as empty
    lengths = lambda pieces: F.transform(pieces, lambda p, i: F.when(i % 3 == 2, 0).otherwise(F.length(p)))
    one = lambda pieces, at, i: F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(pieces, i).alias("whole"), F.get(pieces, i + 1).alias("value"))

    def few(pieces: Column, n: int) -> Column:
        piece = lambda i: F.get(pieces, F.lit(i))
        end, out = F.lit(0), []
        for i in range(0, 3 * n, 3):
            start = end + F.length(piece(i))
            end = start + F.length(piece(i + 1))
            out.append(F.struct(start.alias("start"), end.alias("end"), piece(i + 1).alias("whole"), piece(i + 2).alias("value")))
        return F.array(*out)

    def every(pieces: Column) -> Column:
        nth = F.slice(F.sequence(F.lit(1), F.size(pieces) + 1, F.lit(3)), F.lit(1), F.floor(F.size(pieces) / 3).cast("int"))
        many = let(let(lengths(pieces), lambda n: running(n)), lambda at: F.transform(nth, lambda i: one(pieces, at, i)))
        # up to two matches, as most texts have, without a running sum
        return F.when(F.size(pieces) == 4, few(pieces, 1)).when(F.size(pieces) == 7, few(pieces, 2)).when(F.size(pieces) < 4, F.slice(few(pieces, 1), F.lit(1), F.lit(0))).otherwise(many)

    # bound as a lambda's variable, the replacement is computed once
    return let(F.split(text, f"[{_OPEN}{_GROUP}{_CLOSE}]", -1), every)


def spans(text: Column, pattern: str) -> Column:
    """located() matches of a pattern, context assertions seeing the whole text; U+0001 to U+0003 count as U+0004 here."""
    return located(marked(plain_text(text), pattern))


def chunk_paragraphs(c: Column, most: int = 300) -> Column:
    """Paragraphs, those of more words than most as groups of sentences filled greedily; one sentence is never cut."""
    count = lambda x: F.size(F.filter(F.split(x, f"{S}+"), lambda w: w != ""))
    none = F.array().cast("array<string>")

    def groups(p: Column) -> Column:
        first = F.struct(none.alias("out"), none.alias("held"), F.lit(0).alias("n"))

        def step(a: Column, x: Column) -> Column:
            full = (a["n"] + count(x) > most) & (F.size(a["held"]) > 0)
            new = F.struct(F.concat(a["out"], F.array(F.array_join(a["held"], " "))).alias("out"), F.array(x).alias("held"), count(x).alias("n"))
            more = F.struct(a["out"].alias("out"), F.concat(a["held"], F.array(x)).alias("held"), (a["n"] + count(x)).alias("n"))
            return F.when(full, new).otherwise(more)

        done = lambda a: F.concat(a["out"], F.array(F.array_join(a["held"], " ")))
        return F.aggregate(F.split(F.replace(p, F.lit(". "), F.lit(".\n")), "\n", -1), first, step, done)

    paragraphs = F.filter(F.transform(F.split(c, "\n\n", -1), strip), lambda p: p != "")
    chunks = F.flatten(F.transform(paragraphs, lambda p: F.when(count(p) <= most, F.array(p)).otherwise(groups(p))))
    return F.when(F.size(chunks) > 0, chunks).otherwise(F.array(strip(c)))


def chunk_chars(c: Column, limit: int = 480) -> Column:
    """Pieces of at most limit characters, ended by sentences where possible."""
    none = F.array().cast("array<string>")
    first = F.struct(none.alias("out"), F.lit("").alias("cur"))

    def step(a: Column, x: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(x) + 1 <= limit
        out = F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])
        parts = F.regexp_extract_all(x, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))
        longer = let(parts, lambda ps: F.struct(F.concat(out, F.slice(ps, F.lit(1), F.size(ps) - 1)).alias("out"), F.element_at(ps, -1).alias("cur")))
        other = F.when(F.length(x) <= limit, F.struct(out.alias("out"), x.alias("cur"))).otherwise(longer)
        return F.when(fits, F.struct(a["out"].alias("out"), strip(F.concat(a["cur"], F.lit(" "), x)).alias("cur"))).otherwise(other)

    done = lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"])
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(F.aggregate(F.split(c, f"(?<=[.!?।]){S}+"), first, step, done))


def bad_translation(out: Column, source: Column) -> Column:
    t = strip(F.coalesce(out, F.lit("")))
    n, latin = F.length(t), F.length(F.regexp_replace(t, "[^A-Za-z]", ""))
    return (n == 0) | (n < F.least(F.lit(10), F.floor(F.length(source) / 10))) | ((n > 20) & (latin / F.greatest(n, F.lit(1)) < 0.4))


def translation(text: Column, lang: Column, first: Column, second: Column) -> tuple[Column, Column]:
    """(text, engine) from what the two translators gave (null: failed)."""
    early, ok = lang.isin(dims.SECOND_FIRST), ~bad_translation(first, text)
    got, some = F.coalesce(second, F.lit("")) != "", F.coalesce(first, F.lit("")) != ""
    cases = [
        (F.coalesce(strip(text), F.lit("")) == "", F.lit(""), "noop"), (lang == "en", text, "passthrough"), (early & got, second, "mymemory"), (early & ok, first, "opus-mt-fallback"),
        (early, text, "passthrough-failed"), (ok, first, "opus-mt"), (got, second, "mymemory-fallback"), (some, first, "opus-mt-low-quality"),
    ]
    value, engine = F, F
    for when, v, e in cases:
        value, engine = value.when(when, v), engine.when(when, e)
    return value.otherwise(text), engine.otherwise("passthrough-failed")


def accepted_reply(text: Column, reply: Column, status: Column) -> Column:
    """A translator's reply, or null: empty, an error status, or the text itself."""
    t = strip(reply)
    return F.when((t != "") & (F.coalesce(status, F.lit(200)) < 400) & (F.lower(t) != F.lower(strip(text))), t)
