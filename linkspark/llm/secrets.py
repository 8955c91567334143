"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: any
text that the expression matches satisfies it. The index holds postings
(trigram, document) of the trigrams that the queries name; intersecting them
gives, for each rule, its candidates, and only these are read again and verified
with the expression itself. A rule without mandatory trigrams (``hex``) scans
every text.

Spans are in code points, end exclusive; matches are leftmost and do not overlap
within a kind; a match whose counted part is too short is consumed but dropped.

Defined cases: a null text counts as empty and has no spans; repeated rows give
repeated result rows; null ids are ids like others; an empty table gives an empty
result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of


@dataclass(frozen=True)
class Rule:
    """``pattern``'s ``group`` must have ``least`` code points."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = False


# A key from its header to the END line; without one, over the base64
# after it. Possessive groups, which Java runs in a loop and not by recursion.
_EOL = r"(?:\s|\\[nr])"
_KEY_END = r"[^-]*+(?:-{1,4}[^-]+)*+-----END [A-Z ]*PRIVATE KEY-----"
_KEY_LINES = rf"(?:\s*(?:Proc-Type|DEK-Info): [^\n]*)*+(?:{_EOL}*[A-Za-z0-9+/]{{20,}}={{0,2}})++(?:{_EOL}*\n[\x20\t]*[A-Za-z0-9+/]{{1,19}}={{0,2}}(?=[\x20\t\r]*(?:\n|$)))?"

# The three base kinds, then well-known credential formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_END}|{_KEY_LINES})?", 0, 1),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("web_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)


def _all_of(parts) -> tuple | bool:
    parts = [p for p in parts if p is not True]
    return ("and", *dict.fromkeys(parts)) if parts else True


def _any_of(parts) -> tuple | bool:
    parts = list(parts)
    return True if not parts or True in parts else ("or", *dict.fromkeys(parts))


def _trigrams(strings) -> tuple | bool:
    """What a text that holds one of ``strings`` must hold."""
    return _any_of(_all_of(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def trigram_query(pattern: str) -> tuple | bool:
    """Trigrams, in lower case, of every text that ``pattern`` matches: nested
    ("and", ...) and ("or", ...) over trigrams; True if nothing is mandatory."""

    def of(nodes) -> tuple[list[str], tuple | bool, bool]:
        """The strings that the last literal run may be, what came before it, and
        whether the strings are all of what ``nodes`` match."""
        run, found, whole = [""], [], True
        for op, value in nodes:
            more: list[str] | None = None
            if op is sre.LITERAL:
                more = [chr(value).lower()]
            elif op is sre.IN and all(x[0] is sre.LITERAL for x in value):
                more = sorted({chr(x[1]).lower() for x in value})
            elif op is sre.SUBPATTERN:
                more, inner, full = of(value[3])
                if not full:
                    found.append(inner)
                    found.append(_trigrams(more))
                    more = None
            elif op is sre.BRANCH:
                parts = [of(x) for x in value[1]]
                if all(full for _, _, full in parts):
                    more = sorted({s for strings, _, _ in parts for s in strings})
                else:
                    found.append(_any_of(_all_of([inner, _trigrams(strings)]) for strings, inner, _ in parts))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] == 0 and value[1] == 1:
                strings, _, full = of(value[2])
                more = ["", *strings] if full and len(strings) == 1 else None
            if more is not None and len(run) * len(more) <= 16:
                run = [a + b for a in run for b in more]
            else:
                found.append(_trigrams(run))
                run, whole = [""], False
        return run, _all_of(found), whole

    run, found, _ = of(sre_parser.parse(pattern))
    return _all_of([found, _trigrams(run)])


def named(query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else {t for part in query[1:] for t in named(part)}


def holds(query, has) -> Column:
    """``query`` over columns; ``has(trigram)``: the document is in its postings."""
    if query is True:
        return F.lit(True)
    if isinstance(query, str):
        return has(query)
    parts = [holds(p, has) for p in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    t = text_of(docs, text)
    return docs.select(F.col(key).alias("k"), F.xxhash64(t).alias("h"), t.alias("t"))


def trigram_postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of ``trigrams``: ``tri`` (its place in the list), ``k, h``."""
    low = F.lower("t")
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return keyed.select("k", "h", low.alias("low")).select("k", "h", F.explode(present).alias("tri"))


def candidates(postings: DataFrame, trigrams: list[str], queries: dict[str, tuple]) -> DataFrame:
    """``k, h`` and one flag for each rule, for documents that any query admits."""
    place = {t: i for i, t in enumerate(trigrams)}
    words = range((len(trigrams) + 59) // 60)
    masks = [F.expr(f"bit_or(CASE WHEN tri DIV 60 = {w} THEN shiftleft(1L, tri - {60 * w}) ELSE 0L END)").alias(f"m{w}") for w in words]
    has = lambda t: F.col(f"m{place[t] // 60}").bitwiseAND(F.lit(1 << (place[t] % 60)).cast("bigint")) != 0
    grouped = postings.groupBy("k", "h").agg(*masks)
    flagged = grouped.select("k", "h", *[holds(q, has).alias(f"may_{kind}") for kind, q in queries.items()])
    return flagged.where(" or ".join(f"may_{kind}" for kind in queries))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda binds it, else every use
    inside another lambda would compute it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Running sums of an array, in blocks: m ** 1.5 steps for m entries."""
    block = 256
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    at = lambda i: F.floor(i / block).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), at(F.size(lengths) - 1)), lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))))
    starts = _let(blocks, lambda bs: F.transform(bs, lambda _, b: total(F.slice(bs, F.lit(1), b))))
    return _let(starts, lambda st: F.transform(lengths, lambda _, i: F.get(st, at(i)) + total(F.slice(lengths, at(i) * block + 1, F.pmod(i, F.lit(block)) + 1))))


SPANS = "array<struct<start:int,kind:int,end:int>>"


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """The spans of one rule. The text between matches and the matches themselves
    alternate, so their lengths add up to the places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.zip_with(found, counted, lambda f, c: F.struct(F.length(f).alias("n"), F.length(c).alias("c")))
    span = lambda e, x: F.struct((e - x["n"]).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), (x["c"] >= rule.least).alias("counts"))
    ends = lambda xs: _let(F.zip_with(F.slice(between, F.lit(1), F.size(xs)), xs, lambda a, x: a + x["n"]), _running)
    spans = _let(sizes, lambda xs: F.zip_with(ends(xs), xs, span))
    return F.transform(F.filter(spans, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _spans(text: Column, rule: Rule, kind: int, may: Column) -> Column:
    """As spans_of, only where ``may`` holds and a match of some length exists."""
    # the shortest match that counts: runs are maximal, so a long run has it
    quick = rule.pattern
    if rule.group == 0 and rule.pattern.endswith("]+") and rule.pattern.startswith("["):
        quick = rule.pattern[:-1] + f"{{{rule.least},}}"
    narrow = Rule(rule.kind, quick, rule.group, rule.least, rule.base)
    return F.when(may & F.regexp_like(text, F.lit(quick)), spans_of(text, narrow, kind)).otherwise(F.array().cast(SPANS))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``k, h`` (the key and a hash of the text) and ``spans``, an array of
    (start, kind's place in ``rules``, end), for every row of ``docs``."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not True}
    trigrams = sorted(set().union(*map(named, queries.values())))
    keyed = _keyed(docs, key, text)
    admitted = table(candidates(trigram_postings(keyed, trigrams), trigrams, queries), "secret-candidates")
    meets = lambda a, b: a["k"].eqNullSafe(b["k"]) & (a["h"] == b["h"])
    read = keyed.alias("d").join(admitted.alias("c"), meets(keyed, admitted))
    verified = read.select("d.k", "d.h", F.concat(*[_spans(F.col("d.t"), r, i, F.col(f"c.may_{r.kind}")) for i, r in enumerate(rules) if r.kind in queries]).alias("found"))
    # repeated rows verify alike: one of them is enough
    verified = verified.where(F.size("found") > 0).dropDuplicates(["k", "h"])
    scanned = keyed.select("k", "h", F.concat(*[_spans(F.col("t"), r, i, F.lit(True)) for i, r in enumerate(rules) if r.kind not in queries]).alias("own"))
    whole = scanned.alias("s").join(verified.alias("v"), meets(scanned, verified), "left")
    return whole.select("s.k", "s.h", F.array_sort(F.concat("s.own", F.coalesce("v.found", F.array().cast(SPANS)))).alias("spans"))


def _said(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "<secret>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced; of an assignment, its value.
    Texts without a span are not touched."""
    hit = scan(docs, key, text, rules).where(F.size("spans") > 0).select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.transform("spans", lambda s: s["kind"]).alias("_kinds")).dropDuplicates(["_k", "_h"])
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    both = docs.select(row.alias("row"), F.col(key).alias("_d"), F.xxhash64(text_of(docs, text)).alias("_t"))
    joined = both.join(hit, both["_d"].eqNullSafe(hit["_k"]) & (both["_t"] == hit["_h"]), "left")
    out = F.col(f"row.`{text}`")
    # keys first: another kind's mask inside a key, or in its header, would hide the rest
    for i, rule in sorted(enumerate(rules), key=lambda x: x[1].kind != "private_key"):
        found = F.regexp_extract_all(out, F.lit(rule.pattern), F.lit(0))
        counted = F.regexp_extract_all(out, F.lit(rule.pattern), F.lit(rule.group))
        between = F.split(out, rule.pattern, -1)
        short = rule.least
        masked = F.zip_with(found, counted, lambda f, c: F.when(F.length(c) < short, f).otherwise(F.concat(F.left(f, F.length(f) - F.length(c)), F.lit(mask))))  # noqa: B023
        put = F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(found)), masked, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
        out = F.when(F.array_contains("_kinds", i), put).otherwise(out)
        joined = joined.withColumn("_out", out)
        out = F.col("_out")
    return joined.select(*[(F.col("_out") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda i: F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < sum(r.base for r in RULES))
    return out.select(F.col("k").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_said(base, RULES), 256).alias("base_sha256"), _said(F.col("spans"), RULES).alias("spans"))


