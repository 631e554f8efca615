"""Secret scan: fixed patterns plus sliding-window entropy, in DataFrame functions only.

Method. Candidate strings are runs of token characters. A window of `WINDOW` characters slides over
each; its character counts are kept up incrementally (one in, one out; twelve counts to a long), and with them the sum of
c*log2(c), from which the window's Shannon entropy follows. Windows at or above the threshold of the
candidate's character class (hex digits; letters and digits; the wider token alphabet) make a span from the first to the last such
window, unless an allow-list pattern matches the candidate or a pattern span already covers the place.
Spans of the fixed patterns always stay.

Scale. One projection over the table: nothing is shuffled, nothing leaves the JVM, and the work grows with the length of the text. A
candidate is worked off in pieces of `PIECE` characters that overlap by a window, so a run of a million characters costs no more memory
than one of 30,000. No pattern repeats a group: Java's matcher would recurse once for each repetition and overflow its stack.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20
#: Characters of a candidate that are worked off at once.
PIECE = 32_768
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Bits a character that a window needs, by class.
THRESHOLDS = {"hex": 3.01, "alnum": 3.71, "token": 3.91}
#: With classes of their own for letters and digits of one case and for tokens with both cases and digits: what the pipeline redacts by.
FULL_THRESHOLDS = THRESHOLDS | {"one_case": 3.4, "mixed": 3.71}
PLACEHOLDERS = r"EXAMPLE|example|placeholder|PLACEHOLDER|XXXX|xxxx|0000000000"
#: Candidates that these match are no secrets: identifiers in UUID form, numbers, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[-_/+=0-9]+$",
    PLACEHOLDERS,
)
KEY = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run of these classes is taken whole, so asking for the length in the pattern drops just the short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


HITS = "array<struct<start:int,stop:int,hit:string>>"
#: Matches that are placed together; the lists of such blocks are joined afterwards, so that a text of very many matches isn't copied for each.
BLOCK = 256


def _located(text: Column, pattern: str, group: int = 0, least: int = 0, given: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, stop, match), code points; group `group` has `least` characters at least.

    given: what must hold for a match to be possible at all.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(HITS).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(F.coalesce(x["hit"], F.lit("")))
        here = F.struct(begin.alias("start"), end.alias("stop"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.when(x["hit"].isNotNull() & (F.length(x["part"]) >= least), F.concat(a["out"], F.array(here))).otherwise(a["out"]).alias("out"))

    def behind(a: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda y: F.struct((a["at"] + y["start"]).alias("start"), (a["at"] + y["stop"]).alias("stop"), y["hit"].alias("hit")))
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], moved).alias("out"))

    def placed(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(z), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(z, i, BLOCK), start, step))
        return F.when(F.size(z) <= BLOCK, F.aggregate(z, start, step, lambda a: a["out"])).otherwise(F.aggregate(blocks, start, behind, lambda a: a["out"]))

    found = text.rlike(pattern) if given is None else given & text.rlike(pattern)
    return F.when(found, _bound(zipped, placed)).otherwise(F.array().cast(HITS))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's argument is a value, while a column used twice is an expression evaluated twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain_words(candidate: Column) -> Column:
    """Whether the candidate is letters alone or words of letters with single marks between them and one at the end at most."""
    return candidate.rlike("^[A-Za-z][-_/+A-Za-z]*$") & ~candidate.rlike("[-_/+][-_/+]")


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(kind).alias("kind"))).cast(SPAN)


#: Scale of the integer terms c*log2(c): sums are exact, and equal in any order.
UNIT = 1 << 32
#: A window's counts stand in longs, twelve in each, with five bits for every count.
SLOTS, BITS = 12, 5


def hot_range(candidate: Column, threshold: Column, window: int = WINDOW) -> Column:
    """struct(first, last): begins of the first and last window of the candidate whose entropy reaches the threshold; -1 if none.

    window is below 32. Linear in the candidate's length, which must have ASCII characters alone.
    """
    longs = -(-len(ALPHABET) // SLOTS)
    term = F.array(*[F.lit(round(c * math.log2(c) * UNIT) if c else 0) for c in range(window + 2)])
    unit = F.array(*[F.lit(1 << BITS * (i % SLOTS)) for i in range(len(ALPHABET))])
    home = F.array(*[F.lit(i // SLOTS + 1) for i in range(len(ALPHABET))])
    none = F.struct(F.array(*[F.lit(0).cast("long")] * longs).alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    # entropy = log2(window) - sum / (window * UNIT), so a hot window is one whose sum is small
    allowance = F.floor((F.lit(math.log2(window) + 1e-9) - threshold) * float(window * UNIT))

    def count(a: Column, code: Column) -> Column:
        """How often the window has the character of this code (1 and up)."""
        return F.call_function("div", F.element_at(a["n"], F.element_at(home, code)), F.element_at(unit, code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def changed(n: Column, code: Column, sign: int) -> Column:
        """The counts with one character more, or less."""
        return F.transform(n, lambda v, j: F.when(j + 1 == F.element_at(home, code), v + sign * F.element_at(unit, code)).otherwise(v))

    def leave(a: Column, old: Column) -> Column:
        c = count(a, old)
        return F.struct(changed(a["n"], old, -1).alias("n"), (a["sum"] - F.element_at(term, c + 1) + F.element_at(term, c)).alias("sum"), a["i"].alias("i"), a["first"].alias("first"), a["last"].alias("last"))

    def enter(a: Column, new: Column) -> Column:
        c = count(a, new)
        return F.struct(changed(a["n"], new, 1).alias("n"), (a["sum"] - F.element_at(term, c + 1) + F.element_at(term, c + 2)).alias("sum"), (a["i"] + 1).alias("i"), a["first"].alias("first"), a["last"].alias("last"))

    def noted(a: Column, most: Column) -> Column:
        high = (a["i"] >= window) & (a["sum"] <= most)
        return F.struct(a["n"].alias("n"), a["sum"].alias("sum"), a["i"].alias("i"), F.when(high & (a["first"] < 0), a["i"] - window).otherwise(a["first"]).alias("first"), F.when(high, a["i"] - window).otherwise(a["last"]).alias("last"))

    def slide(a: Column, x: Column, most: Column) -> Column:
        """x: 128 * code of the character that comes in + code of the one that goes out (0: none). Out first, so the counts stay those of one window."""
        new, old = F.shiftright(x, 7), x.bitwiseAND(F.lit(127))
        before = F.when(old > 0, _bound(a, lambda b: leave(b, F.greatest(old, F.lit(1))))).otherwise(a)
        return _bound(_bound(before, lambda b: enter(b, new)), lambda b: noted(b, most))

    def scan(codes: Column, most: Column) -> Column:
        behind = F.concat(F.array_repeat(F.lit(0), window), codes)
        steps = F.zip_with(codes, F.slice(behind, 1, F.size(codes)), lambda new, old: new * 128 + old)
        return F.aggregate(steps, none, lambda a, x: slide(a, x, most), lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    def piece(raw: Column, at: Column, most: Column) -> Column:
        # bytes are cut out in constant time, characters would be counted from the start
        codes = F.transform(F.split(F.substring(raw, at + 1, F.lit(PIECE + window - 1)).cast("string"), ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
        found = _bound(codes, lambda c: scan(c, most))
        return _bound(found, lambda r: F.struct(F.when(r["first"] >= 0, at + r["first"]).otherwise(-1).alias("first"), F.when(r["last"] >= 0, at + r["last"]).otherwise(-1).alias("last")))

    def joined(pieces: Column) -> Column:
        return F.struct(F.coalesce(F.array_min(F.filter(F.transform(pieces, lambda r: r["first"]), lambda i: i >= 0)), F.lit(-1)).alias("first"), F.array_max(F.transform(pieces, lambda r: r["last"])).alias("last"))

    def whole(raw: Column, most: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.octet_length(raw) - 1, F.lit(0)), F.lit(PIECE))
        return _bound(F.transform(begins, lambda at: piece(raw, at, most)), joined)

    return _bound(candidate.cast("binary"), lambda raw: _bound(allowance, lambda most: whole(raw, most)))


def _masked(candidate: Column) -> Column:
    """The candidate with placeholder words as runs of one character, so that a window with such a word has little entropy."""
    return F.regexp_replace(F.regexp_replace(candidate, "EXAMPLE|example", "=" * 7), "PLACEHOLDER|placeholder", "=" * 11)


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOW, thresholds: dict[str, float] = THRESHOLDS, keep: tuple[str, ...] = (), overlapping: bool = False) -> DataFrame:
    """doc_id, text, n_assign, n_access, n_hex and spans: array of (start, rank, stop, kind) by start, in code points, stop exclusive; columns of `keep` follow.

    Kinds: assign, access, hex (all kept) and entropy (only where no other span overlaps and no allow-list pattern matches).
    overlapping: entropy spans stay where other spans overlap them, and placeholder words hide only the windows that they stand in, not the candidate.
    allow: patterns of further candidates to pass over, besides those of plain words. They must not repeat a group.
    Null texts count as empty and have no spans; rows that repeat are all returned. keep must not name doc_id, text or a result column.
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    df = df.select("*", _located(t, ASSIGN, 1, 6).alias("_a"), _located(t, CANDIDATE).alias("_c"))
    # matches of these two stand within candidates
    some = F.size("_c") > 0
    df = df.select("*", _located(t, ACCESS, given=some).alias("_k"), _located(t, HEX, given=some).alias("_h"))
    df = df.select("*", F.concat(_spans(F.col("_a"), "assign", 0), _spans(F.col("_k"), "access", 1), _spans(F.col("_h"), "hex", 2)).alias("_base"))
    if overlapping:
        allow = tuple(p for p in allow if p != PLACEHOLDERS)
    allowed = "|".join(f"(?:{p})" for p in allow)
    candidates = F.filter("_c", lambda x: ~(_plain_words(x["hit"]) | x["hit"].rlike(allowed) if allow else _plain_words(x["hit"])))
    classes = [("hex", "^[0-9a-fA-F]+$"), ("one_case", r"^(?=.*[0-9])(?:[a-z0-9]+|[A-Z0-9]+)$"), ("alnum", "^[0-9A-Za-z]+$"), ("mixed", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])")]

    def limit(hit: Column) -> Column:
        return F.coalesce(*[F.when(hit.rlike(p), F.lit(thresholds[k])) for k, p in classes if k in thresholds], F.lit(thresholds["token"]))

    hot = F.transform(candidates, lambda x: F.struct(x["start"].alias("start"), hot_range(_masked(x["hit"]) if overlapping else x["hit"], limit(x["hit"])).alias("r")))
    hot = F.transform(F.filter(hot, lambda x: x["r"]["first"] >= 0), lambda x: F.struct((x["start"] + x["r"]["first"]).alias("start"), F.lit(3).alias("rank"), (x["start"] + x["r"]["last"] + WINDOW).alias("stop"), F.lit("entropy").alias("kind"))).cast(SPAN)
    df = df.select("*", F.when(F.size("_c") > 0, hot).otherwise(F.array().cast(SPAN)).alias("_hot"))
    fresh = F.col("_hot") if overlapping else F.filter("_hot", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return df.select("doc_id", "text", F.size("_a").cast("long").alias("n_assign"), F.size("_k").cast("long").alias("n_access"), F.size("_h").cast("long").alias("n_hex"), F.array_sort(F.concat("_base", fresh)).alias("spans"), *keep)


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping ones, replaced by the mark; spans in order of start. Null stays null.

    Spans are worked off in blocks, each with its own stretch of the text: a place in a string is found by counting from its start.
    """

    def segment(i: Column) -> Column:
        stops = lambda n: F.array_max(F.transform(F.slice(spans, 1, n), lambda x: x["stop"]))
        until = F.when(i + BLOCK > F.size(spans), F.length(text)).otherwise(stops(i + (BLOCK - 1)))
        ends = F.struct(F.coalesce(stops(i - 1), F.lit(0)).alias("lo"), until.alias("hi"))
        return _bound(ends, lambda r: _bound(F.substring(text, r["lo"] + 1, r["hi"] - r["lo"]), lambda t: marked(F.slice(spans, i, BLOCK), t, r)))

    def marked(some: Column, t: Column, r: Column) -> Column:
        """t: the text from r.lo to r.hi."""

        def step(a: Column, x: Column) -> Column:
            gap = F.substring(t, a["at"] - r["lo"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
            return F.struct(F.greatest(a["at"], x["stop"]).alias("at"), F.when(x["start"] >= a["at"], F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"))

        start = F.struct(r["lo"].alias("at"), F.lit("").alias("out"))
        return F.aggregate(some, start, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] - r["lo"] + 1, F.greatest(r["hi"] - a["at"], F.lit(0)))))

    done = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.size(spans), F.lit(1)), F.lit(BLOCK)), segment), "")
    return F.when(F.size(spans) > 0, done).otherwise(text)
