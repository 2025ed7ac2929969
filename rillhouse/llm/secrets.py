"""Secret scans with a trigram inverted index, in DataFrame operations only.

From each rule's pattern a Boolean query over trigrams is derived: an OR of alternatives, each an AND of trigrams that
any match must contain. Postings (trigram, document) are built for the trigrams that the queries name, intersected per
document, and only documents that satisfy a rule's query are verified with its pattern. A rule without mandatory
trigrams (plain hexadecimal runs) scans every text.

Defined results: a null or empty text has no spans; rows that repeat a doc_id are scanned each for itself; a null
doc_id is kept; an empty table gives no rows; a very long text is scanned whole; other columns, of whatever name, are
never read and pass through scan() and redact() unchanged. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .words import fresh


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # the same meaning in Java and Python
    least: int  # characters that `group` must have
    group: int = 0
    any_case: bool = False
    enough: str = ""  # a pattern of the matches of `pattern` that have the length, and of no others

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + (self.enough or self.pattern)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, enough=r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 24, enough=r"[0-9a-f]{24,}"),
)
#: Spans beyond the base ones.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36}", 1),
)
MASK = "[secret]"
_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string>>"


def finite(node, most: int = 64) -> list[set[str] | None]:
    """A pattern's sequence as pieces: each the set of all its strings, or None if they are too many."""
    out: list[set[str] | None] = []
    for op, arg in node:
        name, strings = str(op), None
        if name == "LITERAL":
            strings = {chr(arg)}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in arg):
            chars = {c for o, a in arg for c in ([a] if str(o) == "LITERAL" else range(a[0], a[1] + 1))}
            strings = {chr(c) for c in chars} if len(chars) <= 8 else None
        elif name == "SUBPATTERN":
            out += finite(arg[-1])
            continue
        elif name == "BRANCH":
            strings = set()
            for alt in arg[1]:
                parts = finite(alt)
                if None in parts:
                    strings = None
                    break
                strings |= {"".join(p) for p in product(*parts)}
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 2:
            parts = finite(arg[2])
            if None not in parts:
                once = {"".join(p) for p in product(*parts)}
                strings = {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(once, repeat=n)}
        out.append(strings if strings is None or len(strings) <= most else None)
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of which one must hold: sets of lower-case trigrams that must all occur; none: no mandatory ones."""
    best: list[frozenset[str]] = []
    run: set[str] = {""}
    for piece in [*finite(re._parser.parse(pattern)), None]:
        longer = None if piece is None else {a + b for a in run for b in piece}
        if longer is not None and len(longer) <= 64:
            run = longer
            continue
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in run}
            least = sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)
            if not best or min(map(len, least)) > min(map(len, best)):
                best = least
        run = {""} if piece is None else set(piece)
    return best


#: Trigrams whose presence one 64-bit number holds.
BITS = 62


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]]:
    """The inverted index, restricted to the trigrams of the rules' queries: (trigram number, doc_id, text_hash).

    The lists of an alternative are intersected from its last trigram on: the others are looked for only in the
    documents of that list.
    """
    alts = sorted({alt for r in rules for alt in trigram_query(r.pattern)}, key=sorted)
    grams = sorted({g for alt in alts for g in alt})
    lead = {alt: max(alt) for alt in alts}
    leads = sorted(set(lead.values()))
    name = {g: f"lead_{i}" for i, g in enumerate(leads)}
    some = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low"))
    some = some.select("*", *(F.col("low").contains(g).alias(name[g]) for g in leads))

    def place(i: int, g: str) -> Column:
        own = [F.col(name[lead[alt]]) for alt in alts if g in alt]
        return F.when(F.col(name[g]) if g in name else reduce(lambda a, b: a | b, own) & F.col("low").contains(g), F.lit(i))

    some = some.where(reduce(lambda a, b: a | b, (F.col(x) for x in name.values())))
    return some.select("doc_id", "text_hash", F.explode(F.array_compact(F.array(*(place(i, g) for i, g in enumerate(grams))))).alias("trigram")), grams


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents whose postings satisfy a rule's query: cand_id, cand_hash and for each rule with a query may_<kind>."""
    index, grams = postings(docs, rules)
    bit = lambda k: F.when(F.floor(F.col("trigram") / BITS) == k, F.expr(f"shiftleft(1L, trigram % {BITS})")).otherwise(F.lit(0).cast("long"))
    have = index.groupBy(F.col("doc_id").alias("cand_id"), F.col("text_hash").alias("cand_hash")).agg(*(F.bit_or(bit(k)).alias(f"have_{k}") for k in range(-(-len(grams) // BITS))))

    def all_of(alt: frozenset[str]) -> Column:
        masks: dict[int, int] = {}
        for g in alt:
            i = grams.index(g)
            masks[i // BITS] = masks.get(i // BITS, 0) | 1 << i % BITS
        return reduce(lambda a, b: a & b, (F.col(f"have_{k}").bitwiseAND(F.lit(m)) == m for k, m in masks.items()))

    ask = [r for r in rules if trigram_query(r.pattern)]
    holds = [reduce(lambda a, b: a | b, (all_of(alt) for alt in trigram_query(r.pattern))).alias(f"may_{r.kind}") for r in ask]
    out = have.select("cand_id", "cand_hash", *holds)
    return out.where(reduce(lambda a, b: a | b, (F.col(f"may_{r.kind}") for r in ask)))


def found(rule: Rule, rank: int) -> Column:
    """Spans of one rule, leftmost and without overlap: lengths of what is between matches and of the matches add up."""
    text = F.coalesce(F.col("text"), F.lit(""))
    match = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else match
    parts = F.arrays_zip(F.split(text, rule.java, -1).alias("gap"), match.alias("match"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
        more = F.when(F.length(x["value"]) >= rule.least, F.concat(acc["spans"], F.array(span).cast(_SPAN))).otherwise(acc["spans"])
        return F.when(x["match"].isNull(), acc).otherwise(F.struct(stop.alias("at"), more.alias("spans")))

    none = F.array().cast(_SPAN)
    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)["spans"]
    return F.when(text.rlike(rule.java), spans).otherwise(none)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, name: str = "secret_spans") -> DataFrame:
    """docs with the column `name`, in place of one of that name: all spans by start, then by the rules' order."""
    docs = docs.drop(name)
    cand = candidates(docs.select("doc_id", "text"), rules)
    own = {c: fresh(docs, c) for c in cand.columns}
    cand = cand.withColumnsRenamed(own)
    both = docs.join(cand, F.col("doc_id").eqNullSafe(F.col(own["cand_id"])) & (F.xxhash64("text") == F.col(own["cand_hash"])), "left")
    none = F.array().cast(_SPAN)
    spans = [F.when(F.coalesce(own[f"may_{r.kind}"], F.lit(False)), found(r, k)).otherwise(none) if trigram_query(r.pattern) else found(r, k) for k, r in enumerate(rules)]
    return both.select(*docs.columns, F.array_sort(F.concat(*spans)).alias(name))


def line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    got = scan(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["rank"] == k)).cast("long")
    return got.select("doc_id", *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span (overlapping ones as one) replaced by MASK; n_chars, if there, follows the text."""
    name = fresh(docs, "secret_spans")
    got = scan(docs, name=name)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        text = F.when(fresh, F.concat(acc["out"], F.expr("text").substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), text.alias("out"))

    done = F.aggregate(name, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.expr("text").substr(a["at"] + 1, F.length("text"))))
    out = got.withColumn("text", F.when(F.size(name) > 0, done).otherwise(F.col("text"))).drop(name)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every whole text."""
    return report(table(spark, sf_dir, "documents"))


#: The same for DuckDB: matches and gaps between them, by the pattern alone.
SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rule(kind, rank, pat, grp, least) AS (VALUES
  ('assign', 0, '((?i)(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 3, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20), ('hex', 2, '[0-9a-f]+', 0, 24),
  ('private_key', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1), ('code_host', 4, 'gh[pousr]_[A-Za-z0-9]{36}', 0, 1)),
m AS (
  SELECT doc_id, kind, rank, least, string_split_regex(text, '((?i)(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
    regexp_extract_all(text, '((?i)(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits,
    regexp_extract_all(text, '((?i)(password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 3) AS vals FROM d, rule WHERE kind = 'assign'
  UNION ALL SELECT doc_id, kind, rank, least, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d, rule WHERE kind = 'access'
  UNION ALL SELECT doc_id, kind, rank, least, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM d, rule WHERE kind = 'hex'
  UNION ALL SELECT doc_id, kind, rank, least, string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM d, rule WHERE kind = 'private_key'
  UNION ALL SELECT doc_id, kind, rank, least, string_split_regex(text, 'gh[pousr]_[A-Za-z0-9]{36}'), regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36}'), regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36}') FROM d, rule WHERE kind = 'code_host'),
u AS (SELECT doc_id, kind, rank, least, unnest(list_zip(gaps[:len(hits)], hits, vals)) AS x, generate_subscripts(hits, 1) AS i FROM m WHERE len(hits) > 0),
s AS (SELECT doc_id, kind, rank, least, x[2] AS hit, x[3] AS val,
  CAST(sum(length(x[1]) + length(x[2])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM u),
k AS (SELECT doc_id, kind, rank, stop - length(hit) AS start, stop FROM s WHERE length(val) >= least),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
