"""Secret scans by a trigram inverted index, on DataFrame operations only.

Each rule is a regular expression. ``trigram_query`` derives from it which trigrams a match must
hold, as an OR of ANDs. The index keeps, per segment of documents and trigram, the postings of the
documents that hold it; a clause intersects the postings of its trigrams, a rule joins its
clauses, and only the documents found are verified with the expression itself. Rules without a
mandatory trigram scan every document.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import packed


@dataclass(frozen=True)
class Rule:
    """A match of ``pattern`` counts when group ``group`` has ``least`` code points or more."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds. A maximal run holds at most one match of access and of hex, so their least
#: lengths (20 and 24) stand in the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further well-known token formats.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("login", r"://[A-Za-z0-9._-]+:[A-Za-z0-9._%+!*-]{3,}@"),
)
RULES = BASE + ADDED

#: An element of an expression that stands for more strings than this counts as unknown.
MOST_STRINGS = 64


def _strings(item) -> set[str] | None:
    """All strings an element can match, or None when they are too many."""
    op, arg = str(item[0]), item[1]
    if op == "LITERAL":
        return {chr(arg).lower()}
    if op == "IN":
        out = set()
        for kind, value in arg:
            span = {"LITERAL": lambda v: range(v, v + 1), "RANGE": lambda v: range(v[0], v[1] + 1)}.get(str(kind))
            if span is None or len(span(value)) > 8:
                return None
            out |= {chr(c).lower() for c in span(value)}
        return out if len(out) <= 8 else None
    if op == "MAX_REPEAT":
        low, high, body = arg
        one = _sequence(body) if high <= 4 else None
        if one is None:
            return None
        out = set()
        for n in range(low, high + 1):
            out |= {"".join(x) for x in itertools.product(one, repeat=n)}
        return out if len(out) <= MOST_STRINGS else None
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        each = [_sequence(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The OR of ANDs of lower-case trigrams that every match of ``pattern`` holds; None: no such."""
    factors, run = [], {""}
    for item in [*_parser.parse(pattern), None]:
        more = _strings(item) if item else None
        if more and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        factors.append(run)
        run = more or {""}
    factors.append(run)
    clauses: list[frozenset[str]] = [frozenset()]
    for factor in factors:
        if min(map(len, factor)) >= 3 and len(clauses) * len(factor) <= MOST_STRINGS:
            each = {frozenset(x[i:i + 3] for i in range(len(x) - 2)) for x in factor}
            clauses = [a | b for a in clauses for b in sorted(each, key=sorted)]
    clauses = [c for c in dict.fromkeys(clauses) if not any(other < c for other in clauses)]
    return None if frozenset() in clauses else clauses


def _key() -> Column:
    """The id as a string that is never null, so that null ids join too."""
    return F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("null"))


def build_index(docs: DataFrame, trigrams: list[str], segment_rows: int = 4096) -> DataFrame:
    """Postings (segment, trigram, keys) of the trigrams that some rule asks for. A segment holds
    about ``segment_rows`` documents, so a postings list stays that short however common its trigram."""
    segments = docs.count() // segment_rows + 1
    low = docs.select(_key().alias("key"), F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return (low.select("key", F.explode(held).alias("trigram")).distinct()
            .groupBy(F.pmod(F.xxhash64("key"), F.lit(segments)).alias("segment"), "trigram")
            .agg(F.collect_list("key").alias("keys")))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(key, kinds): the indexed rules whose trigram query the document fulfils."""
    spark = docs.sparkSession
    rows = [(r.kind, n, t, len(clause)) for r in rules for n, clause in enumerate(trigram_query(r.pattern) or [])
            for t in sorted(clause)]
    if not rows:
        return None
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, need int")
    index = build_index(docs, sorted({t for _, _, t, _ in rows}))
    both = F.aggregate(F.slice("lists", 2, F.size("lists")), F.element_at("lists", 1), lambda a, x: F.array_intersect(a, x))
    return (index.join(clauses, "trigram")
            .groupBy("segment", "kind", "clause", "need").agg(F.collect_list("keys").alias("lists"))
            .filter(F.size("lists") == F.col("need"))
            .select("kind", F.explode(both).alias("key"))
            .groupBy("key").agg(F.collect_set("kind").alias("kinds")))


def _spans(n: int, rule: Rule) -> Column:
    """Structs (start, rank, end) of rule ``n`` from its matches ``m{n}``, their checked parts ``b{n}``
    and ``s{n}``, the lengths from the end of one match to the end of the next. The ends are sums
    over blocks of 64 lengths and then within one block, so that many matches stay cheap."""
    return F.expr(f"""
        CASE WHEN size(m{n}) > 0 THEN
          transform(array(transform(sequence(0, (size(m{n}) - 1) div 64),
                                    k -> aggregate(slice(s{n}, k * 64 + 1, 64), 0L, (a, x) -> a + x))), blocks ->
            transform(filter(sequence(0, size(m{n}) - 1), i -> length(b{n}[i]) >= {rule.least}), i ->
              transform(array(aggregate(slice(blocks, 1, i div 64), 0L, (a, x) -> a + x)
                              + aggregate(slice(s{n}, (i div 64) * 64 + 1, i % 64 + 1), 0L, (a, x) -> a + x)), e ->
                struct(e - length(m{n}[i]) AS start, {n} AS rank, e AS end))[0]))[0]
        ELSE array() END""").cast("array<struct<start:bigint,rank:int,end:bigint>>")


def _scan(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The packed documents with ``key``, ``text`` and one column of spans per rule, ``f0`` on."""
    work = packed(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("key", _key())
    found = candidates(work.select("doc_id", "text"), rules)
    work = work.join(found, "key", "left") if found is not None else work.withColumn("kinds", F.lit(None).cast("array<string>"))
    one = F.array().cast("array<string>")
    plain = ["_doc", "doc_id", "text"]
    ask = {n: F.lit(True) if trigram_query(r.pattern) is None else F.coalesce(F.array_contains("kinds", r.kind), F.lit(False))
           for n, r in enumerate(rules)}
    work = work.select(*plain, *[F.when(ask[n], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(one).alias(f"m{n}")
                                 for n, r in enumerate(rules)])
    work = work.select(*plain, *[f"m{n}" for n in range(len(rules))],
                       *[F.when(F.size(f"m{n}") > 0, F.split("text", r.pattern, -1)).otherwise(one).alias(f"p{n}") for n, r in enumerate(rules)],
                       *[(F.when(F.size(f"m{n}") > 0, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).otherwise(one)
                          if r.group else F.col(f"m{n}")).alias(f"b{n}") for n, r in enumerate(rules)])
    work = work.select("*", *[F.expr(f"zip_with(slice(p{n}, 1, size(m{n})), m{n}, (p, m) -> cast(length(p) + length(m) AS bigint))").alias(f"s{n}")
                              for n in range(len(rules))])
    return work.select(*plain, *[_spans(n, r).alias(f"f{n}") for n, r in enumerate(rules)])


def _listed(rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of the sorted spans ``x``, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """The secrets of every whole text, one row per input row: doc_id, a count ``n_<kind>`` for each of
    the first ``base`` rules, ``base_sha256`` (digest of their spans) and ``spans`` (those of all rules).

    A span is kind:start:end in code points, end exclusive, ordered by start and then by the order of
    the rules. Per rule matches are leftmost and non-overlapping; one whose checked group is too short
    is dropped. A null or empty text has no span and an empty list. Null and repeated ids and repeated
    rows each give their own row; further columns are ignored; an empty table gives no row.
    """
    work = _scan(docs, rules)
    work = work.select("doc_id", *[f"f{n}" for n in range(len(rules))],
                       F.array_sort(F.concat(*[F.col(f"f{n}") for n in range(base)])).alias("first"),
                       F.array_sort(F.concat(*[F.col(f"f{n}") for n in range(len(rules))])).alias("every"))
    listed = _listed(rules)
    return work.select("doc_id", *[F.size(f"f{n}").cast("long").alias(f"n_{r.kind}") for n, r in enumerate(rules[:base])],
                       F.sha2(listed(F.col("first")), 256).alias("base_sha256"), listed(F.col("every")).alias("spans"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """All input columns and rows, with every span of ``text`` replaced by ``mark`` (overlapping spans
    by one mark) and ``n_chars``, where there is one, counted anew for changed texts. Texts without a
    span, null ones included, stay as they are."""
    work = _scan(docs, rules).select("_doc", "text", F.array_sort(F.concat(*[F.col(f"f{n}") for n in range(len(rules))])).alias("every"))
    merged = F.expr("""aggregate(every, array(), (a, x) -> CASE
        WHEN size(a) > 0 AND x.start < element_at(a, -1).end THEN concat(slice(a, 1, size(a) - 1),
          array(struct(element_at(a, -1).start AS start, greatest(element_at(a, -1).end, x.end) AS end)))
        ELSE concat(a, array(struct(x.start AS start, x.end AS end))) END)""".replace(
        "array(), (a", "cast(array() AS array<struct<start:bigint,end:bigint>>), (a"))
    work = work.withColumn("cuts", F.when(F.size("every") > 0, merged))
    clean = F.expr("""concat_ws('', concat(
        transform(cuts, (x, i) -> concat(substring(text, cast(IF(i = 0, 0L, cuts[i - 1].end) AS int) + 1,
          cast(x.start - IF(i = 0, 0L, cuts[i - 1].end) AS int)), '{mark}')),
        array(substring(text, cast(element_at(cuts, -1).end AS int) + 1))))""".replace("{mark}", mark.replace("'", "\\'")))
    work = work.withColumn("clean", F.when(F.col("cuts").isNotNull(), clean))
    new = {"text": F.when(F.col("cuts").isNotNull(), F.col("clean")).otherwise(F.col("_doc").getField("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cuts").isNotNull(), F.length("clean").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(F.col("_doc").getField("n_chars"))
    return work.select(*[new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in docs.columns])
