"""Mixing sources to target weights by hierarchical budgeting.

Weights stand at the nodes of a tree domain -> language -> source. A node's token budget is dealt to
its children by weight. A child that can't use its share (all its documents, ``epochs`` times) gets
what it can use, and its shortage is dealt again among its siblings by their weights; only what
the siblings can't use goes up to the parent's siblings. Within a leaf each epoch has an order
of its own, by a seeded hash of the document; a leaf takes whole epochs while its budget has room for
them, then the longest prefix of the next one within the budget.

Leaves are bounded by the tree, which is configuration; leaf totals are the only rows that the driver
gets. A prefix is found without sorting a leaf: its hashes are counted into equal classes, the class in which the budget ends
into finer ones, and so on until a class is small; just that one is ordered. So a leaf with a third of all rows costs no more in a
task than any other. Documents themselves aren't shuffled: selection is a filter against each
leaf's last hash.

Defined cases: a null text has 0 tokens and comes along free of cost in every epoch its leaf takes;
documents whose leaf isn't in the tree (null language or source included) belong to the leaf ``OTHER`` if the
tree has it, as the production tree does, and else aren't taken; nor are those of a leaf of weight 0;
rows equal in doc_id and text have equal hashes and are taken together or not at all.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from colstate.llm import common

Tree = dict[tuple[str, ...], float]

#: A tree with this leaf has room for every document: it gets those that no other leaf is for.
OTHER = ("other", "other", "other")


def allocate(weights: Tree, able: dict[tuple[str, str, str], int], total: int) -> dict[tuple[str, str, str], int]:
    """Budget of each leaf ``(domain, language, source)``.

    ``weights`` has a weight for every node, by its path from the root; ``able``: the tokens that a
    leaf can give. Shares are exact fractions, a leaf's budget is rounded down to whole tokens.
    """
    children: dict[tuple, list[tuple]] = {}
    for path, w in weights.items():
        if w > 0:
            children.setdefault(path[:-1], []).append(path)

    def room(node: tuple) -> int:
        return able.get(node, 0) if len(node) == 3 else sum(map(room, children.get(node, ())))

    rooms = {p: room(p) for p in weights}
    out: dict = {leaf: 0 for leaf in able}

    def deal(node: tuple, amount: Fraction) -> None:
        if len(node) == 3:
            out[node] = int(amount)
            return
        todo, rest = [c for c in children.get(node, ()) if rooms[c]], amount
        while todo:
            whole = sum(Fraction(weights[c]) for c in todo)
            full = [c for c in todo if rest * Fraction(weights[c]) / whole >= rooms[c]]
            if not full:
                for c in todo:
                    deal(c, rest * Fraction(weights[c]) / whole)
                return
            for c in full:  # they take what they can; the shortage stays in rest for their siblings
                deal(c, Fraction(rooms[c]))
                rest -= rooms[c]
                todo.remove(c)

    deal((), Fraction(min(total, sum(rooms[c] for c in children.get((), ())))))
    return out


def tokens_of(column: str = "text") -> Column:
    """White-space separated tokens; another measure can be given to mix()."""
    return F.regexp_count(common.text_of(column), F.lit(r"\S+")).cast("long")


def order_key(seed: int, epoch: Column) -> Column:
    """A document's place in the order of an epoch."""
    return F.xxhash64(F.lit(seed), epoch.cast("long"), F.col("doc_id").cast("long"), common.text_of())


def _leaf(domains: dict[str, str], leaves: list[tuple[str, ...]]) -> Column:
    """The leaf's path as one string; outside the tree that of OTHER, if the tree has it."""
    domain = F.create_map(*[F.lit(x) for kv in sorted(domains.items()) for x in kv])[F.col("source")] if domains else F.lit(None)
    path = F.concat_ws("\x1f", F.when(domain.isNotNull() & F.col("lang").isNotNull(), domain), "lang", "source")
    if OTHER not in leaves:
        return path
    return F.when(path.isin(*["\x1f".join(p) for p in leaves]), path).otherwise("\x1f".join(OTHER))


def mix(
    docs: DataFrame,
    weights: Tree,
    domains: dict[str, str],
    *,
    total: int | float,
    epochs: int = 2,
    seed: int = 7,
    tokens: Column | None = None,
    counts: DataFrame | None = None,
    class_bits: int = 8,
    class_rows: int = 4096,
) -> DataFrame:
    """The rows of ``docs (doc_id, text, lang, source, ...)`` in the mixture, with ``mix_leaf, mix_epoch`` added (or replaced, if there).

    ``total``: tokens, or as a float their share of all tokens of the tree. ``domains``: source -> domain. Tokens are counted by
    ``tokens``, or looked up in ``counts (digest, n_tokens)`` by the SHA-256 of the text; a text that isn't there has none.
    """
    spark = docs.sparkSession
    leaves = sorted(p for p in weights if len(p) == 3)
    names = {"\x1f".join(p): p for p in leaves}
    own_columns = [c for c in docs.columns if c not in ("mix_leaf", "mix_epoch")]
    row = F.struct(*[F.col(f"`{c}`") for c in own_columns]).alias("row")
    rows = docs.select(_leaf(domains, leaves).alias("mix_leaf"), row, F.col("doc_id"), F.col("text"))
    # a light table for the passes that follow: nothing of the text but its count and hash
    key_parts = [F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")]
    light = docs.withColumn("mix_leaf", _leaf(domains, leaves))
    light = light.where(F.col("mix_leaf").isin(*names)) if names else light.limit(0)
    keys = [order_key(seed, F.lit(e)).alias(f"k{e}") for e in range(1, epochs + 1)]
    if counts is None:
        counted = light.select("mix_leaf", (tokens if tokens is not None else tokens_of()).alias("n"), *key_parts).select("mix_leaf", "n", *keys)
    else:  # digests and keys are shuffled, texts aren't
        counted = light.select("mix_leaf", *key_parts).select("mix_leaf", F.unhex(F.sha2("text", 256)).alias("digest"), *keys)
        counted = counted.join(counts, "digest", "left").withColumn("n", F.coalesce("n_tokens", F.lit(0).cast("long"))).drop("digest", "n_tokens")
    counted = common.written(counted, common.work_dir(spark, "op3") + "/counted")
    have = {names[r["mix_leaf"]]: r["n"] for r in counted.groupBy("mix_leaf").agg(F.sum("n").alias("n")).collect()}
    sought = int(total * sum(have.values())) if isinstance(total, float) else total
    budgets = allocate(weights, {p: n * epochs for p, n in have.items()}, sought)

    plan = []  # a row a leaf: whole epochs, tokens left for the prefix of the next
    for p, n in have.items():
        whole = min(epochs, budgets[p] // n) if n else epochs * (weights[p] > 0)
        plan.append(("\x1f".join(p), whole, budgets[p] - whole * n if n else 0))
    kind = "mix_leaf string, whole int, left bigint"
    plan = F.broadcast(spark.createDataFrame(plan, kind))  # a row a leaf of the tree

    part = counted.join(plan, "mix_leaf").where((F.col("whole") < epochs) & (F.col("left") > 0))
    pick = reduce(lambda c, e: c.when(F.col("whole") == e, F.col(f"k{e + 1}")), range(1, epochs), F.when(F.col("whole") == 0, F.col("k1")))
    part = part.select("mix_leaf", "left", "n", pick.alias("k"))
    inside, bits, ends = part.withColumn("before", F.lit(0).cast("long")), 0, []
    while True:
        bits = min(bits + class_bits, 63)
        sums = inside.groupBy("mix_leaf", F.shiftright("k", 64 - bits).alias("c")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("left").alias("left"), F.first("before").alias("before")
        )
        up_to = Window.partitionBy("mix_leaf").orderBy("c")  # a row a class, 2 ** class_bits at most
        found = sums.withColumn("run", F.col("before") + F.sum("n").over(up_to)).where("run > left")
        found = found.groupBy("mix_leaf").agg(F.min_by(F.struct("c", (F.col("run") - F.col("n")).alias("before"), "rows"), "c").alias("e"))
        ends = [(x["mix_leaf"], x["c"], x["before"], x["rows"]) for x in found.select("mix_leaf", "e.*").collect()]  # a row a leaf
        at = F.broadcast(spark.createDataFrame([x[:3] for x in ends], "mix_leaf string, c bigint, before bigint"))
        inside = part.withColumn("c", F.shiftright("k", 64 - bits)).join(at, ["mix_leaf", "c"]).drop("c")
        if bits == 63 or all(x[3] <= class_rows for x in ends):
            break
    run = Window.partitionBy("mix_leaf").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("run", F.col("before") + F.sum("n").over(run)).where("run <= left")
    last = {x["mix_leaf"]: x["k"] for x in inside.groupBy("mix_leaf").agg(F.max("k").alias("k")).collect()}  # a row a leaf
    cuts = {leaf: (c, last.get(leaf)) for leaf, c, *_ in ends}

    rules = []  # leaf, whole epochs, last hash of the next (null: none of it; the largest: all of it)
    for leaf, whole, left in ((r["mix_leaf"], r["whole"], r["left"]) for r in plan.collect()):
        top: int | None
        if whole >= epochs or left <= 0:
            top = None
        elif leaf not in cuts:
            top = (1 << 63) - 1
        else:
            c, k = cuts[leaf]
            top = k if k is not None else (c << (64 - bits)) - 1
            top = None if top < -(1 << 63) else top
        rules.append((leaf, whole, top))
    rules = F.broadcast(spark.createDataFrame(rules, "mix_leaf string, mix_whole int, mix_top bigint"))
    chosen = rows.join(rules, "mix_leaf")
    extra = order_key(seed, F.col("mix_whole") + 1) <= F.col("mix_top")
    takes = F.col("mix_whole") + F.when(extra, 1).otherwise(0)
    chosen = chosen.select("mix_leaf", "row", takes.alias("takes")).where("takes > 0")
    return chosen.select("row.*", "mix_leaf", F.explode(F.sequence(F.lit(1), F.col("takes"))).alias("mix_epoch"))


# the production tree --------------------------------------------------------------------------

SOURCES = [f"src{i}" for i in range(20)]
DOMAINS = {s: "web" if i < 10 else "books" if i < 15 else "reference" for i, s in enumerate(SOURCES)}
LANGS = ("de", "en", "es", "fr")


def production_weights() -> Tree:
    """web, books and reference 6 : 2 : 2; English 6, the others 1 to 2; the crawl ``src0`` counts as five sources.

    Other sources and languages, nulls included, are one leaf with half the weight of books; without such documents its
    share goes to the rest.
    """
    tree: Tree = {("web",): 6, ("books",): 2, ("reference",): 2, OTHER[:1]: 1, OTHER[:2]: 1, OTHER: 1}
    for domain in ("web", "books", "reference"):
        for lang, w in zip(LANGS, (1.5, 6, 1, 1.5)):
            tree[domain, lang] = w
            for s in SOURCES:
                if DOMAINS[s] == domain:
                    tree[domain, lang, s] = 5 if s == "src0" else 1
    return tree
