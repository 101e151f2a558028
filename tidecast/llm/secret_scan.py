"""Secret scan with built-in Spark functions only.

Two kinds of finding.  Base rules are patterns: assignments to a credential
name, access keys and long hexadecimal runs.  The entropy rule takes candidate
strings (maximal runs of key characters) and slides each class's window over the
maximal stretches of its alphabet in them; the window's Shannon entropy follows from the change
that the incoming and the outgoing character make to sum(c * log2(c)) over the
character counts c, so no window is counted anew.  Candidates on the allow-list
are suppressed; of one that holds a placeholder or counting run, the parts
between slashes are candidates of their own.  Base findings are never suppressed.

Positions are code points, end exclusive.  A pattern's matches and the pieces
between them (the same pattern as separator) give the positions without a
user-defined function.

Defined results: null or empty text has no findings; rows that repeat an id are
scanned on their own; a null doc_id is kept; empty tables give empty results;
other columns are ignored; texts of any length are scanned whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed values of the base rules: names, value alphabet, least lengths.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(either_case(n) for n in NAMES) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 8
ACCESS = "AKIA[A-Z0-9]{12,}"   # AKIA[A-Z0-9]+ of 16 characters or more: a shorter match hides no longer one
HEX = "[0-9a-f]{32,}"          # runs are maximal, so the least length can be part of the pattern
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
#: Candidates that are no secrets: no digit at all (words, paths, identifiers), one repeated
#: character, counting or alphabet runs, placeholders, UUIDs, dates and numbers with separators.
PARTS = "[A-Za-z0-9+_-]{20,}"  # between slashes
ALLOW = (
    "[^0-9]*",
    r"(.)\1*",
    "(?i).*(0123456789|abcdefghij|qwertyuiop).*",
    "(?i).*(example|sample|dummy|placeholder|changeme|xxxxxx).*",
    "[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    "[0-9+/_-]*",
)


@dataclass(frozen=True)
class EntropyClass:
    """Stretches of ``alphabet``, the window and its least entropy in bits."""

    kind: str
    alphabet: str
    window: int
    bits: float


# No window is longer than the shortest candidate.  24 characters of 4.0 bits hold 20 of 3.6 at the least.
CLASSES = (EntropyClass("entropy_hex", "[0-9a-fA-F]+", 20, 2.75),
           EntropyClass("entropy_base64", "[A-Za-z0-9+/_-]+", 20, 3.6))

BLOCK = 256


def running_sum(values: Column) -> Column:
    """Sums before each element of an array<int>, in blocks: the array that a
    fold grows is copied per element, so it stays short."""
    def before(part: Column, start: Column) -> Column:
        step = F.aggregate(part, F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
                           lambda a, v: F.struct((a["at"] + v).alias("at"), F.array_append(a["all"], a["at"]).alias("all")))
        return step["all"]
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v))
    starts = before(sums, F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, before))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of the leftmost non-overlapping matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    lengths = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
    starts = running_sum(lengths)
    at = F.zip_with(starts, F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("text"))),
                    lambda s, x: F.struct((s + x["gap"]).alias("start"), x["text"].alias("text")))
    none = F.expr("cast(array() as array<struct<start: int, text: string>>)")
    return F.when(text.rlike(pattern), F.filter(at, lambda x: x["text"].isNotNull() & x["start"].isNotNull())).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"),
                                                 (m["start"] + F.length(m["text"])).alias("end")))


def _weight(count: Column) -> Column:
    """c * log2(c), 0 for no characters."""
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def _gain(window: Column, char: Column) -> Column:
    """What one more ``char`` adds to sum(c * log2(c)) of the window."""
    count = F.length(window) - F.length(F.replace(window, char, F.lit("")))
    return _weight(count + 1) - _weight(count)


def high_entropy(text: Column, window: int, bits: float) -> Column:
    """struct<low, high>: where the windows of at least ``bits`` begin and end
    within ``text`` (code points, end exclusive); high is 0 without such a window."""
    def change(i: Column) -> Column:
        inner = F.substr(text, F.greatest(F.lit(1), i - window + 1), F.least(i - 1, F.lit(window - 1)))
        add = _gain(inner, F.substr(text, i, F.lit(1)))
        drop = F.when(i > window, _gain(inner, F.substr(text, i - window, F.lit(1)))).otherwise(F.lit(0.0))
        return add - drop

    changes = F.transform(F.sequence(F.lit(1), F.length(text)), change)
    most = F.log2(F.lit(float(window)))

    def step(a: Column, d: Column) -> Column:
        at, total = a["at"] + 1, a["sum"] + d
        passes = (at >= window) & (most - total / window >= bits)
        return F.struct(at.alias("at"), total.alias("sum"),
                        F.when(passes & (a["high"] == 0), at - window).otherwise(a["low"]).alias("low"),
                        F.when(passes, at).otherwise(a["high"]).alias("high"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    return F.aggregate(changes, start, step, lambda a: F.struct(a["low"].alias("low"), a["high"].alias("high")))


def entropy_spans(text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> Column:
    """Spans of the candidates' high-entropy stretches (first to last passing window).  The
    last class's alphabet is that of candidates; the stretches of a class before it are
    found inside them and reported where no stretch of the last class covers them."""
    *inner, last = classes

    def suppressed(s: Column) -> Column:
        out = F.lit(False)
        for pattern in allow:
            out = out | s.rlike(rf"\A(?:{pattern})\z")
        return out

    def moved(found: Column, by: Column) -> Column:
        return F.transform(found, lambda x: F.struct((by + x["start"]).alias("start"), x["text"].alias("text")))

    def parts(m: Column) -> Column:
        holds = [pattern for pattern in allow if pattern.startswith("(?i).*")]
        held = F.lit(False)
        for pattern in holds:
            held = held | m["text"].rlike(rf"\A(?:{pattern})\z")
        return F.when(held, moved(matches(m["text"], PARTS), m["start"])).otherwise(F.array(m))

    def spans_of(c: EntropyClass):
        def spans(m: Column) -> Column:
            window = F.transform(F.array(m), lambda x: F.struct(
                x["start"].alias("at"), high_entropy(x["text"], c.window, c.bits).alias("w")))
            return F.transform(F.filter(window, lambda x: x["w"]["high"] > 0), lambda x: F.struct(
                (x["at"] + x["w"]["low"]).alias("start"), F.lit(KINDS.index(c.kind)).alias("kind"),
                (x["at"] + x["w"]["high"]).alias("end")))
        return spans

    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)")

    def judge(m: Column) -> Column:
        whole = F.lit(False)
        for c in inner:
            whole = whole | m["text"].rlike(rf"\A{c.alphabet}\z")
        out = F.when(whole, none).otherwise(spans_of(last)(m))
        for c in inner:
            run = c.alphabet.removesuffix("+") + "{%d,}" % c.window
            stretches = F.filter(moved(matches(m["text"], run), m["start"]), lambda x: ~suppressed(x["text"]))
            found = F.flatten(F.transform(stretches, spans_of(c)))
            out = F.transform(F.array(F.struct(out.alias("out"), found.alias("more"))), lambda x: F.concat(x["out"], F.filter(
                x["more"], lambda n: ~F.exists(x["out"], lambda o: (o["start"] <= n["start"]) & (o["end"] >= n["end"])))))[0]
        return out

    open_ = F.filter(F.flatten(F.transform(matches(text, CANDIDATE), parts)), lambda m: ~suppressed(m["text"]))
    return F.flatten(F.transform(open_, judge))


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """doc_id, base and found: arrays of struct<start, kind, end> in order of start and kind
    (kind: an index into KINDS); found holds the base findings too."""
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= ASSIGN_VALUE)
    access = F.when(F.contains(text, F.lit("AKIA")), matches(text, ACCESS)).otherwise(
        F.expr("cast(array() as array<struct<start: int, text: string>>)"))
    base = F.array_sort(F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(matches(text, HEX), "hex")))
    rows = docs.select("doc_id", base.alias("base"), entropy_spans(text, classes, allow).alias("more"))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("found"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy."""
    found = scan(docs)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
                        (F.size("found") - F.size("base")).cast("long").alias("n_entropy"))
