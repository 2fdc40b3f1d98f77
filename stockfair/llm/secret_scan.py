"""Secret scans over an incremental blob ledger.

Every version of a text is content-addressed (SHA-256 of its UTF-8); the ledger
has one row per blob and rule version with the spans found, none included.  A
run scans only pairs the ledger lacks, each blob once however many paths hold
it, adds them to the ledger and joins findings back to all paths.

Main path: DataFrame functions only.  Matches are located without a UDF:
``split`` gives the text between matches, ``regexp_extract_all`` the matches,
and their lengths in code points add up to places.

Copies: one path per blob is chosen by an aggregate on hashes; its text is
fetched by a join on (blob, path), which spreads a blob that a third of all
rows hold.  Defined cases: null text = empty text; equal rows and ids may repeat
and ids may be null; texts without a match have a ledger row with no spans; an
empty table gives empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockfair.llm.common import stored

SPAN = "array<struct<start:int,end:int>>"
LEDGER = f"blob string, rule string, spans {SPAN}"


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters or more, else the
    match is dropped; spans are of the whole match.  A changed pattern needs a
    new ``version``: the ledger knows rules by kind and version."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: A private key: the header line, then all up to the next END line.  Where no
#: END line follows, the key body's own lines, as many as there are: after a line break
#: (also a written \\n) the optional key headers, whole lines of base64 (16 characters or
#: more), and a last shorter one.  The group over
#: lines is possessive, which Java matches in a loop.
_BREAK = r"(?:\s|\\[rn]){1,4}"
_LINE_END = r"\r|\\[rn]|(?md:$)"
PEM = (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
       r"(?:(?s:.*?)-----END [A-Z ]{0,30}PRIVATE KEY-----"
       rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info): ?[^\n\\]{{0,200}}){{0,4}}"
       rf"(?:{_BREAK}[A-Za-z0-9+/=]{{16,}}+(?={_LINE_END}))++"
       rf"(?:{_BREAK}[A-Za-z0-9+/]{{1,15}}={{0,2}}(?={_LINE_END}))?)?")

#: In listed order: the order of kinds among spans with one start.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, least=6, base=True),
    # a match takes all of its run, so the least lengths can stand in the patterns
    Rule("access", r"AKIA[A-Z0-9]{16,}+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}+", least=24, base=True),
    Rule("pem", PEM, version=3),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of one rule, leftmost, non-overlapping, failing ones dropped."""
    between = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    least = F.transform(hits, lambda h: F.length(h)) if rule.group == 0 else F.transform(
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda h: F.length(h))
    sizes = F.arrays_zip(F.transform(between, lambda p: F.length(p)).alias("gap"),
                         F.transform(hits, lambda h: F.length(h)).alias("size"),
                         least.alias("own"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["own"] >= rule.least, F.concat(acc["out"], span))
                        .otherwise(acc["out"]).alias("out"))

    located = F.aggregate(sizes, zero, add, lambda acc: acc["out"])
    return F.when(text.rlike(rule.pattern), located).otherwise(F.array().cast(SPAN))


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
         id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, new): findings has (id, blob, spans) per row of ``docs``,
    spans an array of (start, order, kind, end, base) sorted by start and rule
    order; new has the ledger rows that this run adds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    paths = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("text"))
    names = [r.name for r in rules]
    chosen = paths.groupBy("blob").agg(F.min("id").alias("id"))
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin(names)).groupBy("blob") \
            .agg(F.collect_set("rule").alias("seen"))  # at most one entry per rule
        chosen = chosen.join(seen, "blob", "left").where(
            F.size(F.coalesce("seen", F.array().cast("array<string>"))) < len(names))
    else:
        chosen = chosen.withColumn("seen", F.lit(None).cast("array<string>"))
    todo = paths.alias("p").join(
        chosen.alias("c"), (F.col("p.blob") == F.col("c.blob")) & F.col("p.id").eqNullSafe(F.col("c.id"))) \
        .select("p.blob", "p.text", F.coalesce("c.seen", F.array().cast("array<string>")).alias("seen"))
    found = F.array(*[F.struct(
        F.lit(r.name).alias("rule"),
        F.when(~F.array_contains("seen", r.name), _spans(F.col("text"), r)).alias("spans"))
        for r in rules])
    new = todo.select("blob", F.explode(found).alias("x")).where("x.spans is not null") \
        .select("blob", "x.rule", "x.spans")
    # equal rows (one id, one text) are chosen together and give equal findings
    new = stored(new.groupBy("blob", "rule").agg(F.first("spans").alias("spans")))

    own = new if ledger is None else new.unionByName(ledger.where(F.col("rule").isin(names)))
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = F.array(*[F.lit(r.base) for r in rules])
    own = own.where(F.size("spans") > 0).withColumn("order", order[F.col("rule")])
    own = own.select("blob", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.col("order").alias("order"),
        F.get(kinds, F.col("order")).alias("kind"), s["end"].alias("end"),
        F.get(base, F.col("order")).alias("base"))).alias("spans"))
    per_blob = own.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = paths.select("id", "blob").join(per_blob, "blob", "left").select(
        F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(
            "array<struct<start:int,order:int,kind:string,end:int,base:boolean>>")).alias("spans"))
    return findings, new


def redacted(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
             id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
             length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by
    ``mark``; ``length_col``, where present, gets the new length of changed
    texts.  All other columns and rows stay."""
    findings, _ = scan(docs, ledger, rules, id_col, text_col)
    hit = findings.where(F.size("spans") > 0).groupBy("blob") \
        .agg(F.first("spans").alias("__llm_spans")).withColumnRenamed("blob", "__llm_blob")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = docs.withColumn("__llm_own", F.sha2(text, 256)).join(hit, F.col("__llm_own") == F.col("__llm_blob"), "left")
    # text before each new span, the mark where a span begins beyond the last end
    zero = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))
    body = F.aggregate("__llm_spans", zero, lambda a, s: F.struct(
        F.greatest(a["end"], s["end"]).alias("end"),
        F.when((s["start"] < a["end"]), a["out"]).otherwise(F.concat(
            a["out"], F.substring(text, a["end"] + 1, s["start"] - a["end"]), F.lit(mark))).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["end"] + 1, F.length(text))))
    new = F.when(F.col("__llm_blob").isNotNull(), body).otherwise(F.col(text_col))
    both = both.withColumn(text_col, new)
    if length_col and length_col in docs.columns:
        both = both.withColumn(length_col, F.when(
            F.col("__llm_blob").isNotNull(), F.length(text_col).cast(docs.schema[length_col].dataType))
            .otherwise(F.col(length_col)))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
