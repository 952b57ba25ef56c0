"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score.

Each kind has an expression, a score to start from, a check of its matches and context words
that raise the score when they stand within WINDOW characters before the match. A span is
reported when its check holds and its score reaches THRESHOLD. The base kinds (email, ip, card,
phone) start above the threshold, so their spans never depend on context; the kinds that the
method adds (iban, ssn, secret) partly do.

The expressions are matched leftmost and without overlap for each kind; a match that fails its
check is dropped and not tried again in a shorter form. Offsets count code points, the end
exclusive.

Defined results: a null or empty text has no spans; kinds may overlap one another; repeated
rows get the same spans; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD, WINDOW, RAISE = 0.5, 48, 0.4
#: Matches before one that its context can reach: each has 7 characters or more.
REACH = WINDOW // 7 + 1
#: Entries of an array that grows, and characters of a chunk of a text that is cut to pieces.
BLOCK, CHUNK = 128, 1024

_DIGITS = "[^0-9]"


def luhn(match: Column) -> Column:
    """The checksum of payment cards over the digits of a match."""
    digits = F.split(F.reverse(F.regexp_replace(match, _DIGITS, "")), "")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(match: Column) -> Column:
    """The checksum of international bank account numbers: the moved and spelled out number is 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), step) == 1


def _n_digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, _DIGITS, ""))


def _octets(match: Column) -> Column:
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: What every text with a match contains; others aren't searched.
    needs: str
    score: float
    check: object = None
    context: tuple[str, ...] = field(default=())


# The expressions of the base kinds. Quantifiers are possessive where nothing that follows can match less, and a
# match begins at the start of a run of its characters or right after the match before, so no long run is walked from each of its places.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@", 0.8),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", 0.6, _octets, ("ip", "host", "server", "address")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}", 0.6, lambda m: _n_digits(m).between(14, 19) & luhn(m), ("card", "visa", "credit")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.6, lambda m: _n_digits(m).between(10, 15), ("phone", "call", "tel")),
)
ADDED = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", 0.7, mod97, ("iban", "account", "bank")),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, lambda m: ~m.rlike("^(000|666|9)|-00-|-0000$"), ("ssn", "social", "security")),
    Kind("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{32}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})(?![0-9A-Za-z])", r"[0-9A-Za-z_]{20}", 0.3, None, ("token", "secret", "key", "password", "passwd", "api")),
)


def _let(value: Column, body) -> Column:
    """``body`` of a lambda variable that holds ``value``: it is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _before(values: Column, combine, depth: int = 2) -> Column:
    """For each of an array's integers, the integers before it combined from 0 on.

    Arrays are copied when something is appended, so sums are made in blocks of BLOCK, of blocks of
    BLOCK, and no array of more than BLOCK entries grows until there are over BLOCK**3.
    """
    none = F.array().cast("array<int>")

    def scan(block: Column, at: Column) -> Column:
        step = lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
        return F.aggregate(block, F.struct(at.alias("at"), none.alias("all")), step, lambda acc: acc["all"])

    if not depth:
        return scan(values, F.lit(0))

    def blocked(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / BLOCK).cast("int") - 1, F.lit(0))
        blocks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        whole = lambda x: F.aggregate(x, F.lit(0), combine)
        return _let(blocks, lambda x: F.flatten(F.zip_with(x, _before(F.transform(x, whole), combine, depth - 1), scan)))

    return _let(values, blocked)


def matches(text: Column, kind: Kind) -> Column:
    """array<struct<kind, start, end, score>> of one kind, with all that its expression proposes and its check confirms.

    The time is linear in the text and its matches: offsets are sums of lengths, and context comes
    from the few gaps and matches before a match.
    """
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    words = rf"(?i)(?<![A-Za-z])({'|'.join(kind.context)})(?![A-Za-z])"

    def located(found: Column, gaps: Column) -> Column:
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.char_length(g) + F.char_length(m))
        ends_before = _before(lengths, lambda x, y: x + y)
        spans = F.transform(F.arrays_zip(found.alias("match"), ends_before.alias("at")), lambda p, i: F.struct(p["match"].alias("match"), (p["at"] + F.char_length(gaps[i])).alias("start"), i.alias("i")))
        if kind.check is not None:
            spans = F.filter(spans, lambda s: kind.check(s["match"]))

        def scored(s: Column) -> Column:
            score = F.lit(kind.score)
            if kind.context:
                first = F.greatest(s["i"] - REACH, F.lit(0))
                back = lambda x, n: F.slice(x, first + 1, n)
                ahead = F.zip_with(back(gaps, s["i"] - first), back(found, s["i"] - first), lambda g, m: F.concat(g, m))
                near = F.right(F.concat(F.array_join(ahead, ""), gaps[s["i"]]), F.lit(WINDOW))
                score = score + F.when(near.rlike(words), F.lit(RAISE)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), (s["start"] + F.char_length(s["match"])).alias("end"), F.least(score, F.lit(1.0)).alias("score"))

        return F.filter(F.transform(spans, scored), lambda s: s["score"] >= THRESHOLD)

    found, gaps = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1)), F.split(text, kind.pattern, -1)
    every = _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(gaps, lambda g: located(m, g))))
    return F.when(text.rlike(kind.needs), every).otherwise(none)


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = BASE + ADDED, to: str = "spans") -> DataFrame:
    """``docs`` with the column ``to``, which replaces one of that name: array<struct<kind, start, end, score>> by start, then kind in the given order."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k.name, i)])
    found = F.concat(*[matches(whole, k) for k in kinds])
    ranked = F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s.alias("span")))
    return docs.withColumn(to, F.transform(F.sort_array(ranked), lambda r: r["span"]))


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, or run of spans that overlap, replaced by the kind of its first in brackets.

    Parts of the text are cut from chunks of CHUNK characters, so that no cut walks the whole text.
    """

    def joined(chunks: Column, spans: Column) -> Column:
        def cut(at: Column, n: Column) -> Column:
            first = F.floor(at / CHUNK).cast("int")
            few = F.floor((at + n) / CHUNK).cast("int") - first + 1
            return F.substring(F.array_join(F.slice(chunks, first + 1, few), ""), at - first * CHUNK + 1, n)

        def piece(s: Column, at: Column) -> Column:
            mark = F.when(s["start"] >= at, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
            return F.concat(cut(at, F.greatest(s["start"] - at, F.lit(0))), mark)

        pieces = F.zip_with(spans, _before(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y)), piece)
        rest = cut(F.array_max(F.transform(spans, lambda s: s["end"])), F.char_length(text))
        return F.concat(F.array_join(pieces, ""), rest)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(_let(chunks, lambda c: _let(spans, lambda x: joined(c, x))))
