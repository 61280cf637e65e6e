"""Mixing sources to target weights by hierarchical budgeting.

Target weights form a tree (domain, language, source).  A token budget flows down it: each node's children share its
budget by weight, and what a child cannot use, for want of tokens, goes to its siblings first and only then, through the
parent's own shortage, to the parent's siblings.  A leaf's budget becomes whole epochs over its documents and a prefix
of one more epoch in an order that the seed fixes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_BREAKS, Scratch, fresh_name, table

SEED, BUDGET_SHARE, MAX_EPOCHS = 20240601, 0.5, 2
LEVELS = ("domain", "lang", "source")
#: About so many documents of a leaf are put in full order, around the end of its prefix.
BUCKET_DOCS = 2_000


@dataclass
class Node:
    """A node of the target tree: its weight among its siblings, and for a leaf the tokens it can give."""

    weight: float = 1.0
    capacity: int = 0
    children: dict[str | None, Node] = field(default_factory=dict)
    budget: int = 0

    def size(self) -> int:
        if self.children:
            self.capacity = sum(c.size() for c in self.children.values())
        return self.capacity


def share(budget: int, weights: list[float], capacities: list[int]) -> list[int]:
    """Splits budget by weight under capacities; shortages go to the others by weight.  Whole numbers, as much as fits."""
    out, left = [0] * len(weights), min(budget, sum(c for w, c in zip(weights, capacities, strict=True) if w > 0))
    open_ = [i for i, w in enumerate(weights) if w > 0 and capacities[i] > 0]
    while left > 0 and open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] / total * left >= capacities[i] - out[i]]
        if full:
            for i in full:
                left -= capacities[i] - out[i]
                out[i] = capacities[i]
            open_ = [i for i in open_ if i not in full]
            continue
        exact = {i: weights[i] / total * left for i in open_}
        for i in open_:
            out[i] += int(exact[i])
        rest = left - sum(int(x) for x in exact.values())
        for i in sorted(open_, key=lambda i: (int(exact[i]) - exact[i], i))[:rest]:
            out[i] += 1
        break
    return out


def spread(node: Node, budget: int) -> None:
    """Gives budget to node and, by weight, to what is below it."""
    node.budget = min(budget, node.capacity)
    names = sorted(node.children, key=lambda n: (n is None, n))
    parts = share(node.budget, [node.children[n].weight for n in names], [node.children[n].capacity for n in names])
    for n, part in zip(names, parts, strict=True):
        spread(node.children[n], part)


def leaf_budgets(totals: list[tuple[tuple, int]], weights: Mapping[tuple, float], budget: int, max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf.  weights: by path, such as ("web",) or ("web", "en"); 1 where it has none.

    The plain form of budgets(), which the tests hold against it.
    """
    root = Node()
    for path, tokens in totals:
        node = root
        for k in range(len(path)):
            node = node.children.setdefault(path[k], Node(weights.get(path[: k + 1], 1.0)))
        node.capacity = tokens * max_epochs
    root.size()
    spread(root, budget)
    out = {}
    for path, _ in totals:
        node = root
        for name in path:
            node = node.children[name]
        out[path] = node.budget
    return out


def _split(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """share() in Spark: nodes (parents, name, capacity, weight, above) with the budget of each, out of its parent's, above.

    A node is full if the level of water, the tokens a weight at which those that fill up earlier are full, reaches it.
    Whole parts first, then one token each by the largest fraction, as share() has it.
    """
    left = F.least(F.col("above"), F.sum("usable").over(Window.partitionBy(*parents)))
    out = nodes.withColumn("usable", F.when((F.col("weight") > 0) & (F.col("capacity") > 0), F.col("capacity")).otherwise(0))
    out = out.withColumn("left", left).withColumn("open", F.col("usable") > 0)
    fill = Window.partitionBy(*parents, "open").orderBy(F.when(F.col("open"), F.col("capacity") / F.col("weight")), F.col(name).asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*parents, "open").orderBy(F.when(F.col("open"), F.col("capacity") / F.col("weight")).desc(), F.col(name).desc_nulls_first())
    after = F.sum("weight").over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = F.col("left") - F.coalesce(F.sum("usable").over(before), F.lit(0))
    out = out.withColumn("full", F.col("open") & (F.col("weight") / after * rest >= F.col("capacity")))
    kind = Window.partitionBy(*parents)
    free = F.col("open") & ~F.col("full")
    out = out.withColumn("free", free).withColumn("rest", F.col("left") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(kind), F.lit(0)))
    out = out.withColumn("exact", F.when(F.col("free"), F.col("weight") / F.sum(F.when(F.col("free"), F.col("weight"))).over(kind) * F.col("rest")))
    out = out.withColumn("part", F.floor("exact")).withColumn("more", F.col("rest") - F.sum("part").over(kind))
    rank = F.row_number().over(Window.partitionBy(*parents, "free").orderBy(F.col("part") - F.col("exact"), F.col(name).asc_nulls_last()))
    own = F.col("part") + F.when(rank <= F.col("more"), 1).otherwise(0)
    return out.select(*parents, name, F.when(F.col("full"), F.col("capacity")).when(F.col("free"), own).otherwise(0).cast("long").alias("budget"))


def _beside(rows: DataFrame, more: DataFrame, keys, how: str = "inner") -> DataFrame:
    """rows with the other columns of more, by keys that may be null."""
    more = more.withColumnsRenamed({k: f"_{k}" for k in keys})
    return rows.join(more, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how).drop(*(f"_{k}" for k in keys))


def budgets(leaves: DataFrame, weights: Mapping[tuple, float], budget: int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, epochs, rest) of the leaves (domain, lang, source, t): leaf_budgets() in Spark, level by level.

    No level comes to the driver, so the number of leaves is not bounded; one task sorts the children of one node.
    """
    spark = leaves.sparkSession
    capacity = leaves.select(*LEVELS, (F.col("t") * max_epochs).alias("capacity"))
    above = None
    for depth in range(1, len(LEVELS) + 1):
        names, parents = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        nodes = capacity.groupBy(*names).agg(F.sum("capacity").alias("capacity"))
        listed = [(*path, float(w)) for path, w in weights.items() if len(path) == depth]
        if listed:
            given = spark.createDataFrame(listed, ", ".join(f"{k} string" for k in names) + ", weight double")
            nodes = _beside(nodes, given, names, "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        else:
            nodes = nodes.withColumn("weight", F.lit(1.0))
        if above is None:
            nodes = nodes.withColumn("above", F.lit(budget).cast("long"))
        else:
            nodes = _beside(nodes, above.withColumnRenamed("budget", "above"), parents)
        above = _split(nodes, parents, names[-1])
    return _beside(leaves, above, LEVELS).select(*LEVELS, F.expr("budget div t").alias("epochs"), F.expr("budget % t").alias("rest"))


def words_of(text: Column) -> Column:
    """Words between white space, the tokens of a budget."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(WORD_BREAKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


def domain_of(source: Column) -> Column:
    """The domain that a source of the test tables belongs to, by its number; null for none."""
    number = F.regexp_extract(source, r"(\d+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("forum"), F.lit("reference")), (F.right(number, F.lit(4)).cast("int") % 4 + 1)))


#: The production targets; languages and sources that are not listed weigh 1 among their siblings.
WEIGHTS = {("web",): 4.0, ("books",): 3.0, ("forum",): 2.0, ("reference",): 1.0, ("web", "en"): 3.0, ("books", "en"): 3.0, ("forum", "en"): 3.0, ("reference", "en"): 3.0}


def _counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, *more: Column) -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, tie) of each row, after more."""
    text = F.col(text_col).cast("string")
    return docs.select(*more, F.col(id_col).alias("doc_id"), domain_of(F.col(source_col)).alias("domain"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), words_of(text).alias("n_tokens"), F.xxhash64(text).alias("tie"))


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"), F.col("tie"))


def _plan(slim: DataFrame, scratch: Scratch, weights: Mapping[tuple, float], budget: int | None, budget_share: float, max_epochs: int, seed: int) -> tuple[DataFrame, DataFrame, Column]:
    """The plan (leaf, epochs, rest), and around the end of each leaf's prefix its rows: equal ones together, as
    (leaf, order, doc_id, tie, n_tokens, copies, at), at: the tokens before them.  Last, the bucket of a row."""
    leaves = scratch.save(slim.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")), "leaves")
    whole, most = leaves.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first()
    plan = scratch.save(budgets(leaves, weights, int(whole * budget_share) if budget is None else budget, max_epochs), "plan")
    buckets = 1 << max(0, (most // BUCKET_DOCS).bit_length())
    bucket = F.shiftrightunsigned("order", 44) % buckets
    part = _beside(slim, plan, LEVELS).where("rest > 0").withColumn("order", _order(seed)).withColumn("bucket", bucket)
    sums = part.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("t"))
    sums = sums.withColumn("before", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("t"))
    # of each leaf, the bucket in which its prefix ends
    sums = scratch.save(_beside(sums, plan.select(*LEVELS, "rest"), LEVELS).where("before < rest and before + t >= rest").drop("t", "rest"), "ends")
    same = [*LEVELS, "bucket"]
    near = _beside(part, sums, same).groupBy(*same, "rest", "before", "order", "doc_id", "tie", "n_tokens").agg(F.count("*").alias("copies"))
    inside = F.sum(F.col("n_tokens") * F.col("copies")).over(Window.partitionBy(*same).orderBy("order", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1))
    return plan, near.withColumn("at", F.col("before") + F.coalesce(inside, F.lit(0))), bucket


def mix(docs: DataFrame, weights: Mapping[tuple, float] = WEIGHTS, budget: int | None = None, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, epoch, domain, lang, source, n_tokens, take): the documents of each epoch and how many of their tokens count.

    budget: in tokens; None: budget_share of all tokens.  Null languages, sources and domains are leaves of their own.
    Documents without tokens are never taken.  Rows that repeat, or have no id, are taken each for itself; those of one
    id and text follow each other in the order.  An empty table gives an empty mix; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    slim = scratch.save(_counted(docs, id_col, text_col, lang_col, source_col).where("n_tokens > 0"), "slim")
    plan, near, bucket = _plan(slim, scratch, weights, budget, budget_share, max_epochs, seed)
    rows = _beside(slim, plan, LEVELS)
    names = ["doc_id", "epoch", *LEVELS, "n_tokens", "take"]
    complete = rows.where("epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1))).withColumn("take", F.col("n_tokens")).select(names)
    part = rows.where("rest > 0").withColumn("order", _order(seed)).withColumn("bucket", bucket).withColumn("epoch", F.col("epochs"))
    ends = docs.sparkSession.read.parquet(f"{scratch.root}/ends").select(*LEVELS, F.col("bucket").alias("end"))
    inside = _beside(part, ends, LEVELS).where("bucket < end").withColumn("take", F.col("n_tokens")).select(names)
    # of equal rows around the end, as many as fit, the last of them in part
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("copies"), F.ceil((F.col("rest") - F.col("at")) / F.col("n_tokens"))) - 1))
    last = near.where("at < rest").withColumn("nth", nth).withColumn("take", F.least("n_tokens", F.col("rest") - F.col("at") - F.col("nth") * F.col("n_tokens")))
    last = _beside(last, plan.select(*LEVELS, F.col("epochs").alias("epoch")), LEVELS).select(names)
    return complete.unionByName(inside).unionByName(last)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of which the mix takes tokens, once and whole, with the columns they had.

    Texts are not cut: the document in which a leaf's prefix ends stays whole.  A row is judged where it is read, by its
    leaf's place of the end, so no text is shuffled.  Rows without an id or of one id are judged each for itself; only of
    equal rows (id and text) around an end, any as many stay as fit.  Rows without words go.  Extra columns, whatever
    their names, pass untouched; an empty table gives an empty one.
    """
    scratch = Scratch(spark, "mixed")
    slim = scratch.save(_counted(docs, "doc_id", "text", "lang", "source").where("n_tokens > 0"), "slim")
    plan, near, bucket = _plan(slim, scratch, WEIGHTS, None, PIPELINE_SHARE, 1, SEED)
    last = near.where("at < rest").groupBy(*LEVELS, "bucket").agg(F.max(F.struct("order", "doc_id", "tie", "n_tokens", "copies", "rest", "at")).alias("m"))
    fits = F.least("m.copies", F.ceil((F.col("m.rest") - F.col("m.at")) / F.col("m.n_tokens")))
    last = scratch.save(last.select(*LEVELS, F.col("bucket").alias("end"), F.struct("m.order", "m.doc_id", "m.tie").alias("upto"), (fits < F.col("m.copies")).alias("partly"), fits.alias("fits")), "last")
    cuts = scratch.save(_beside(plan, last, LEVELS, "left"), "cuts")  # a row for each leaf
    scratch.drop("slim", "leaves", "plan", "ends", "last")
    own, judged = fresh_name(docs.columns, "row"), fresh_name(docs.columns, "judged")
    data = F.struct(*(F.col(c) for c in docs.columns)).alias(own)
    held = _counted(docs, "doc_id", "text", "lang", "source", data)
    held = _beside(held.where("n_tokens > 0"), cuts, LEVELS).withColumn("order", _order(SEED)).withColumn("bucket", bucket)
    here = F.struct("order", "doc_id", "tie")
    held = held.withColumn(judged, (F.col("epochs") > 0) | (F.col("bucket") < F.col("end")) | ((F.col("bucket") == F.col("end")) & (here <= F.col("upto"))))
    tied = F.coalesce(F.col("partly") & (F.col("epochs") == 0) & (here == F.col("upto")), F.lit(False))
    whole = held.where(F.col(judged) & ~tied).select(f"{own}.*")
    if not cuts.where("partly").limit(1).count():
        return whole
    some = scratch.save(held.where(tied).select(own, *LEVELS, "fits", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n")), "some")
    parts = some.groupBy(*LEVELS, "part").agg(F.count("*").alias("c"))
    parts = parts.withColumn("before", F.sum("c").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("c")).drop("c")
    nth = F.row_number().over(Window.partitionBy(*LEVELS, "part").orderBy("n"))
    return whole.unionByName(_beside(some.withColumn("nth", nth), parts, [*LEVELS, "part"]).where("before + nth <= fits").select(f"{own}.*"))


PIPELINE_SHARE = 0.8


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
