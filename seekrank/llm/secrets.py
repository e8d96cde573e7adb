"""Secret scans with an incremental blob ledger; DataFrame functions only.

Every version of every path is content-addressed (sha-256 of its text). The
ledger holds, per scanned blob, the rule versions applied and the spans found.
A scan takes the blobs of the new versions, drops the (blob, rule version)
pairs that the ledger has, scans each remaining blob once, however many paths
and versions hold it, and appends to the ledger. Findings are joined back to
all paths.

Spans are (start, kind, end) in code points, end exclusive. Splitting a text at
a rule's matches gives the pieces between them, so running lengths of pieces
and matches are the positions; they are running sums over exploded pieces, so
a text with very many matches costs no more than its length.

Rules for odd input: a null text is the empty blob; repeated versions give a
row each and one scan; a null path is a path; an empty table gives an empty
result and ledger; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekrank.llm import common


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    hint: str  # every text with a match holds this
    group: int  # whose length counts
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: The rules, in the order in which spans at one place are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 0, 24),  # runs are maximal, so shorter ones never hide a longer one
)
_SPAN = "struct<start:int,kind:int,end:int>"
LEDGER = f"blob string, rules array<string>, spans array<{_SPAN}>"


def content_address(versions: DataFrame) -> DataFrame:
    """Adds ``blob`` and makes a null text the empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.withColumn("text", text).withColumn("blob", F.sha2(F.col("text"), 256))


def _hits(rule: Rule, number: int) -> Column:
    """Struct of pieces, matches and counted groups where the rule can match, else null."""
    text = F.col("text")
    may = F.array_contains("todo", rule.key) & text.rlike(rule.hint)
    if rule.kind == "access":
        may = text.contains("AKIA") & may
    return F.when(may, F.struct(
        F.lit(number).alias("kind"), F.split(text, rule.pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("found"),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)).alias("counted")))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans for blobs (blob, text, todo) with at least one span of a rule in ``todo``."""
    hits = blobs.select("blob", F.explode(F.filter(F.array(*(_hits(r, i) for i, r in enumerate(rules))), lambda h: h.isNotNull())).alias("h"))
    lengths = hits.select("blob", F.col("h.kind").alias("kind"), F.posexplode(F.transform(
        F.arrays_zip("h.between", "h.found", "h.counted"),
        lambda z: F.struct(F.length(z["between"]).alias("gap"), F.length(z["found"]).alias("len"), F.length(z["counted"]).alias("counted")))).alias("i", "z"))
    before = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("z.gap") + F.coalesce("z.len", F.lit(0))).over(before)
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("kind") + 1)
    spans = lengths.select("blob", "kind", "z", end.cast("int").alias("end")).filter(F.col("z.counted") >= least).select(
        "blob", F.struct((F.col("end") - F.col("z.len")).alias("start"), "kind", "end").alias("s"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("spans"))


def unseen(addressed: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, text, todo: one row per blob with rule versions that the ledger lacks for it."""
    every = F.array(*(F.lit(r.key) for r in rules))
    if ledger is None:
        return addressed.select("blob", "text").dropDuplicates(["blob"]).withColumn("todo", every)
    done = ledger.select("blob", F.explode("rules").alias("r")).groupBy("blob").agg(F.collect_set("r").alias("done"))
    fresh = addressed.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    return fresh.filter(F.size("todo") > 0).select("blob", "text", "todo").dropDuplicates(["blob"])


def extend_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that ``ledger`` lacks; append them to it.

    Staged before it is returned: texts cross one shuffle, once per distinct blob.
    """
    todo = unseen(content_address(versions), ledger, rules)
    marks = todo.select("blob", "todo")
    return common.staged(marks.join(scan(todo, rules), "blob", "left").select(
        "blob", F.col("todo").alias("rules"), F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")).alias("spans")), "blob-ledger")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds blob and spans (by start, then kind) to every version; only blobs with spans are joined."""
    found = (ledger.filter(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).distinct()
             .groupBy("blob").agg(F.sort_array(F.collect_list("s")).alias("spans")))
    return versions.join(found, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{_SPAN}>")))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    new = extend_ledger(docs.select("text"), ledger)
    ledger = new if ledger is None else ledger.unionByName(new)
    rows = content_address(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "blob")
    spans = _listed(F.col("spans"), RULES)

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")
    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(RULES)]
    return findings(rows, ledger).select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))
