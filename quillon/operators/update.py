"""Changes to statements: single edits, selected edits, diff, merge, and graphs with history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLANK, COLUMNS, TRIPLE


def add(st: DataFrame, new: DataFrame) -> DataFrame:
    """Appends statements that the same context doesn't have yet."""
    return st.unionByName(new.dropDuplicates(COLUMNS).join(st, COLUMNS, "left_anti"))


def remove(st: DataFrame, old: DataFrame, scoped: bool = False) -> DataFrame:
    """Removes statements, from every context unless scoped."""
    return st.join(old, COLUMNS if scoped else TRIPLE, "left_anti")


def remove_resources(st: DataFrame, subjects: DataFrame) -> DataFrame:
    return st.join(subjects.select("s"), "s", "left_anti")


def replace_values(st: DataFrame, selected: DataFrame, value: Column) -> DataFrame:
    """Selected statements (by their first four columns) get a new object."""
    hit = st.join(selected.select(*TRIPLE).distinct(), TRIPLE, "left_semi").withColumn("o", value).select(*COLUMNS)
    return remove(st, selected).unionByName(hit).dropDuplicates(COLUMNS)


def rename_property(st: DataFrame, selected: DataFrame, p: str) -> DataFrame:
    hit = st.join(selected.select(*TRIPLE).distinct(), TRIPLE, "left_semi").withColumn("p", F.lit(p)).select(*COLUMNS)
    return remove(st, selected).unionByName(hit).dropDuplicates(COLUMNS)


def append_to(st: DataFrame, subjects: DataFrame, rows: list[tuple[str, str, str]], ctx: str = "") -> DataFrame:
    """Gives every selected subject some properties (p, o, otype); the rows are literals of the request."""
    literal = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("p", "o", "otype"), r)]) for r in rows]))
    new = subjects.select("s").distinct().select("s", literal.alias("x")).select("s", "x.*", F.lit(ctx).alias("ctx"))
    return add(st, new)


def for_each(st: DataFrame, selected: DataFrame, build) -> DataFrame:
    """Adds build(selected): statements derived from all selected rows at once, ``$current`` being their columns."""
    return add(st, build(selected).select(*COLUMNS))


def when(st: DataFrame, condition: DataFrame, change) -> DataFrame:
    """change(st) if the condition has a row."""
    return st if condition.isEmpty() else change(st)


def resource_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s, p, o, otype, op) per resource."""
    from .relational import diff

    return diff(old, new, TRIPLE)


def list_order(st: DataFrame, heads: DataFrame) -> DataFrame:
    """(head, pos, item, otype) of RDF lists; a list that runs into itself is an error.

    Jumps double in length each round, so a list of n items takes log2(n) rounds.
    """
    from ..model import FIRST, NIL, REST

    first = st.where(F.col("p") == FIRST).select(F.col("s").alias("cell"), F.col("o").alias("item"), "otype")
    rest = st.where(F.col("p") == REST).select(F.col("s").alias("cell"), F.col("o").alias("next"))
    keep = lambda df: df.checkpoint() if st.sparkSession.sparkContext.getCheckpointDir() else df.persist()
    jump = keep(rest.where(F.col("next") != NIL).distinct())
    most, length = jump.count(), 1
    cells = heads.select(F.col("s").alias("head"), F.col("s").alias("cell"), F.lit(0).cast("long").alias("pos"))
    while True:
        new = keep(cells.join(jump, "cell").select("head", F.col("next").alias("cell"), (F.col("pos") + length).alias("pos")))
        if new.isEmpty():
            break
        if length > most:  # more places than cells
            raise ValueError("circular list")
        cells = keep(cells.unionByName(new))
        then = jump.select(F.col("cell").alias("next"), F.col("next").alias("then"))
        jump = keep(jump.join(then, "next").select("cell", F.col("then").alias("next")))
        length *= 2
    return cells.join(first, "cell").select("head", "pos", "item", "otype")


def reordered(old: DataFrame, new: DataFrame) -> DataFrame:
    """Heads (head, pos, item) whose items are the same but in another order, or differ; ``same_items`` tells which."""

    def lists(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias(name))

    both = lists(old, "a").join(lists(new, "b"), "head").where("a <> b")
    return both.select("head", (F.array_sort("a") == F.array_sort("b")).alias("same_items"))


def merge(st: DataFrame, new: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(adds, removes) that make the given resources in st what new says; doing it twice changes nothing."""
    mine, theirs = (df.join(resources.select("s").distinct(), "s", "left_semi") for df in (st, new))
    return theirs.join(mine, TRIPLE, "left_anti").select(*COLUMNS), mine.join(theirs, TRIPLE, "left_anti").select(*COLUMNS)


def relabel(new: DataFrame, st: DataFrame, suffix: str) -> DataFrame:
    """new with its blank nodes renamed where st uses the same labels."""
    terms = lambda df: df.select(F.col("s").alias("t")).union(df.select("o")).where(F.col("t").startswith(BLANK)).distinct()
    clash = terms(new).join(terms(st), "t", "left_semi").withColumn("u", F.concat("t", F.lit(suffix)))
    out = new
    for c in ("s", "o"):
        out = out.join(clash.withColumnRenamed("t", c), c, "left").withColumn(c, F.coalesce("u", c)).drop("u")
    return out.select(*COLUMNS)


def add_graph(st: DataFrame, new: DataFrame, suffix: str = "x") -> DataFrame:
    """All of new beside st, clashing blank nodes renamed, what is there already skipped."""
    fresh = relabel(new, st, suffix)
    return st.unionByName(fresh.join(st, TRIPLE, "left_anti"))


# contexts and history. A log has seq, version, op (add or remove) and the first four columns.


def context_parts(ctx: Column) -> Column:
    """kind, model, version and source of a context URI: parts are joined by ;; and named by their second word."""
    part = lambda kind, i: F.regexp_extract(ctx, rf"context:{kind}:([^;]*)(?:;([^;:]+))?", i)
    return F.struct(
        F.regexp_extract(ctx, r"^context:(\w+):", 1).alias("kind"),
        part("txn", 1).alias("model"),
        part("txn", 2).alias("version"),
        F.regexp_extract(ctx, r";;(?:context:)?source:(.*)$", 1).alias("source"),
    )


def transaction_context(model: str, version: Column) -> Column:
    return F.concat(F.lit(f"context:txn:{model};"), version.cast("string"))


def replay(log: DataFrame) -> DataFrame:
    """Statements alive after the whole log: the last operation on a statement wins."""
    last = log.groupBy(*TRIPLE).agg(F.max_by("op", "seq").alias("op"), F.max("version").alias("version"))
    return last.where("op = 'add'").drop("op")


def cancelled(log: DataFrame) -> DataFrame:
    """The log without changes that a later one of the same statement in the same version overrules."""
    w = Window.partitionBy(*TRIPLE, "version").orderBy(F.col("seq").desc())
    return log.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def spans(log: DataFrame) -> DataFrame:
    """(s, p, o, otype, added, deleted): versions between which a statement was alive; deleted is null while it is.

    Repeated adds or removes of a statement count once.
    """
    w = Window.partitionBy(*TRIPLE).orderBy("seq")
    changes = cancelled(log).withColumn("__before", F.lag("op").over(w)).where("op <> coalesce(__before, 'remove')")
    ends = changes.withColumn("deleted", F.lead("version").over(w))
    return ends.where("op = 'add'").select(*TRIPLE, F.col("version").alias("added"), "deleted")


def at_version(alive: DataFrame, version: int) -> DataFrame:
    """Statements as of a version."""
    return alive.where((F.col("added") <= version) & (F.col("deleted").isNull() | (F.col("deleted") > version))).select(*TRIPLE)


def revisions(log: DataFrame) -> DataFrame:
    """(s, revision, version): versions that changed a subject, numbered from 1."""
    return log.select("s", "version").distinct().withColumn("revision", F.row_number().over(Window.partitionBy("s").orderBy("version")))


def at_revision(log: DataFrame, revision: int) -> DataFrame:
    """Statements of each subject as of its n-th revision."""
    when_ = revisions(log).where(F.col("revision") == revision).select("s", "version")
    return spans(log).join(when_, "s").where("added <= version and (deleted is null or deleted > version)").select(*TRIPLE)


def modified_after(log: DataFrame, version: int, ignoring: int | None = None) -> DataFrame:
    changes = log if ignoring is None else log.where(F.col("version") != ignoring)
    return changes.groupBy("s").agg(F.max("version").alias("version")).where(F.col("version") > version)


def live_in_graphs(st: DataFrame) -> DataFrame:
    """In how many graphs each statement is said; it stays visible until none is left."""
    return st.groupBy(*TRIPLE).agg(F.countDistinct("ctx").alias("graphs"))
