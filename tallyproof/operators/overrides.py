"""Edits that lie over parsed values, and the store they are kept in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyproof.functions.text import slug, valid_id
from tallyproof.sources.files import settled


def patch(values: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """`values(keys, value)` with edits over them: an edit wins even if it is empty."""
    over = edits.select(*keys, F.col("value").alias("new"), F.lit(True).alias("edited"))
    out = values.join(over, keys, "left")
    return out.select(*keys, F.when(F.col("edited"), F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce("edited", F.lit(False)).alias("edited"))


def carry(edits: DataFrame, allowed: DataFrame, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Edits (keys, value) that still mean something on a newer document: their
    place exists there, and the parsed value under them is the same as it was."""
    kept = edits.join(allowed.select(*keys).distinct(), keys, "left_semi")
    kept = kept.join(old.select(*keys, F.col("value").alias("was")), keys, "left").join(new.select(*keys, F.col("value").alias("now")), keys, "left")
    return kept.where(F.col("was").eqNullSafe(F.col("now"))).drop("was", "now")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by one aggregation: a key with very many rows is
    reduced before it is shuffled."""
    others = [c for c in rows.columns if c not in keys]
    top = F.max(F.struct(*order, *(c for c in others if c not in order))).alias("top")
    return rows.groupBy(*keys).agg(top).select(*keys, *(F.col("top").getField(c).alias(c) for c in others))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Last writer wins, key by key; a change wins over a row of the same time."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return latest(both, keys, [at, "__new"]).drop("__new")


def orphans(stored: DataFrame, *references: DataFrame) -> DataFrame:
    """Stored keys (column sha) that none of the references name."""
    named = references[0]
    for r in references[1:]:
        named = named.unionByName(r)
    return stored.join(named.where("sha is not null").distinct(), "sha", "left_anti")


def servable(parses: DataFrame, lines: DataFrame) -> DataFrame:
    return parses.join(lines.select("sha").distinct(), "sha", "left_semi")


def newest(parses: DataFrame, owner: str, at: str) -> DataFrame:
    return latest(parses, [owner], [at])


def allowed_edits(form: DataFrame, paths: DataFrame, keys: list[str]) -> DataFrame:
    return form.join(paths.select(*keys).distinct(), keys, "left_semi")


def numbered_slugs(names: DataFrame, slug_col: str, order: list[str]) -> DataFrame:
    """slug, slug-2, slug-3 for names that share one, in the given order."""
    nr = F.row_number().over(Window.partitionBy(slug_col).orderBy(*order))
    return names.withColumn("person_id", F.when(nr == 1, F.col(slug_col)).otherwise(F.concat(F.col(slug_col), F.lit("-"), nr.cast("string"))))


def profile_rows(raw: DataFrame) -> DataFrame:
    """Stored profiles (person_id, content) to (person_id, display_name, active_sha,
    n_answers): empty, broken or foreign content reads as an empty profile, and a
    file that only has answers as a profile with those."""
    shape = "version int, display_name string, active_sha string, eeo struct<answers: map<string, array<string>>>, answers map<string, array<string>>"
    at = F.from_json("content", shape)
    answers = F.coalesce(at["eeo"]["answers"], F.when(at["version"].isNull(), at["answers"]))
    return raw.select("person_id", F.coalesce(at["display_name"], F.lit("")).alias("display_name"), at["active_sha"].alias("active_sha"), F.coalesce(F.size(answers), F.lit(0)).alias("n_answers"), answers.isNotNull().alias("answered"))


def positions(rows: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """`rows` numbered from 1 in a global order: sorted in ranges, each of which begins
    behind the counts of those before it, so that no task sorts them all."""
    cut = settled(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = cut.groupBy("__range").agg(F.count("*").alias("n")).select("__range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"))
    nr = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return cut.join(F.broadcast(before), "__range").withColumn(name, (nr + F.col("__before")).cast("int")).drop("__range", "__before")


#: Rows of a range, about: more rows make more ranges, not larger ones.
RANGE_ROWS = 500_000


def ranked_within(rows: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """`rows` numbered from 1 within each group, however large: sorted in ranges of (keys,
    order), each of which begins behind what those before it hold of the same group. The
    order must tell the rows of a group apart, or ties get any of their numbers."""
    ranges = max(rows.sparkSession.sparkContext.defaultParallelism, rows.count() // RANGE_ROWS + 1)
    cut = settled(rows.repartitionByRange(ranges, *keys, *order).withColumn("__range", F.spark_partition_id()))
    ahead = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    held = cut.groupBy(*keys, "__range").agg(F.count("*").alias("n"))
    before = held.select("__range", *(F.col(k).alias(f"__of_{k}") for k in keys), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))
    out = cut.join(before.withColumnRenamed("__range", "__at"), same & (F.col("__range") == F.col("__at"))).repartition(ranges, "__range", *keys)
    nr = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order))
    return out.select(*rows.columns, (nr + F.col("__before")).alias(name))


def uncontained(owned: DataFrame, allowed: DataFrame, owner: list[str], items: list[str]) -> DataFrame:
    """(owner, n_owned, n_outside): how many of an owner's items, repeats counted and nulls
    equal to each other, there aren't among those allowed; 0 where they are a subset.
    Counted on both sides before the shuffle, never listed."""
    side = lambda df, mine: df.select(*owner, *items, F.lit(mine).alias("mine"), F.lit(1 - mine).alias("theirs"))
    each = side(owned, 1).unionByName(side(allowed, 0)).groupBy(*owner, *items).agg(F.sum("mine").alias("mine"), F.sum("theirs").alias("theirs"))
    out = each.groupBy(*owner).agg(F.sum("mine").alias("n_owned"), F.sum(F.greatest(F.col("mine") - F.col("theirs"), F.lit(0))).alias("n_outside"))
    return out.where("n_owned > 0")


def lifted(legacy: DataFrame, people: DataFrame) -> DataFrame:
    """A single profile of the old layout (content) as the person `default`, named Me:
    only where there are no people yet and the content can be read; else no row."""
    read = profile_rows(legacy.select(F.lit("default").alias("person_id"), "content"))
    good = legacy.select(F.from_json("content", "version int, answers map<string, array<string>>, eeo struct<answers: map<string, array<string>>>").alias("at"))
    sound = good.where("at.version is not null or at.answers is not null or at.eeo is not null").select(F.lit("default").alias("person_id")).distinct()
    empty = people.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("default").alias("person_id"))  # one row or none
    return read.withColumn("display_name", F.lit("Me")).join(sound, "person_id", "left_semi").join(empty, "person_id", "left_semi")


def _lifted_content(legacy: DataFrame) -> DataFrame:
    """(person_id, content): the old content as a whole profile, if it can be read."""
    shape = "version int, active_sha string, answers map<string, array<string>>, eeo struct<answers: map<string, array<string>>>"
    at = F.from_json("content", shape)
    answers = F.coalesce(at["eeo"]["answers"], F.when(at["version"].isNull(), at["answers"]))
    sound = at["version"].isNotNull() | at["answers"].isNotNull() | at["eeo"].isNotNull()
    whole = F.struct(F.lit(1).alias("version"), F.lit("Me").alias("display_name"), at["active_sha"].alias("active_sha"), F.struct(answers.alias("answers")).alias("eeo"))
    return legacy.where(sound).select(F.lit("default").alias("person_id"), F.to_json(whole).alias("content"))


def _same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def migrate(spark: SparkSession, legacy: str, store: str, stop_after: str | None = None) -> str:
    """Moves the single profile of the old layout (a JSON file) into `store` as the person
    `default`, and makes that one the active one. Gives what became of it: nothing (no old
    file), kept (there are people already), unreadable, differs, or moved.

    In two phases: the profile is written beside the store, read back and compared row by
    row; only then is it renamed into it, the pointer set, and the old file renamed to end
    in `.migrated`. It may break off anywhere (`stop_after` does so in tests): until the
    last step the old file is as it was, and a rerun does what was left, or nothing.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    old, people, trial, pointer = at(legacy), at(f"{store}/people/default"), at(f"{store}/_moving"), at(f"{store}/active")
    fs = old.getFileSystem(conf)

    def step(name: str) -> None:
        if name == stop_after:
            raise InterruptedError(name)

    def rename(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"cannot rename {a} to {b}")

    if not fs.exists(old):
        return "nothing"
    made = _lifted_content(spark.read.text(legacy, wholetext=True).toDF("content"))
    if fs.exists(at(f"{store}/people")) and len(fs.listStatus(at(f"{store}/people"))) > 0:
        # ours from a run that broke off, or people who came by another way
        if not fs.exists(people) or not _same_rows(spark.read.parquet(str(people)), made):
            return "kept"
    else:
        if made.isEmpty():
            return "unreadable"
        made.write.mode("overwrite").parquet(str(trial))
        step("written")
        if not _same_rows(spark.read.parquet(str(trial)), made):
            fs.delete(trial, True)
            return "differs"
        step("compared")
        fs.mkdirs(people.getParent())
        rename(trial, people)
        step("placed")
    if not fs.exists(pointer):
        spark.createDataFrame([("default",)], "person_id string").write.mode("overwrite").parquet(f"{store}/_pointing")
        rename(at(f"{store}/_pointing"), pointer)
    step("pointed")
    rename(old, at(f"{legacy}.migrated"))
    return "moved"


def _numbered(taken: DataFrame, names: DataFrame) -> DataFrame:
    """`names` (slug, ord) with the ids that are free beside those taken: the r-th new one
    of a slug gets its r-th free number. A taken number t that is the i-th taken one has
    t - i free ones below it, so that new ones in order of r and taken ones in order of
    t - i, each behind the r that equals it, stand in the places of their numbers."""
    stem, digits = F.regexp_extract("person_id", r"^(.+)-([2-9]|[1-9]\d+)$", 1), F.regexp_extract("person_id", r"^(.+)-([2-9]|[1-9]\d+)$", 2)
    numbers = taken.select(F.col("person_id").alias("slug"), F.lit(1).cast("long").alias("t")).unionByName(taken.where(stem != "").select(stem.alias("slug"), digits.try_cast("long").alias("t")))
    numbers = numbers.where("t is not null").distinct().join(names.select("slug").distinct(), "slug", "left_semi")
    gaps = ranked_within(numbers, ["slug"], ["t"], "i").select("slug", (F.col("t") - F.col("i")).alias("at"), F.lit(1).alias("held"), F.col("t").alias("tie"), F.lit(None).cast("string").alias("display_name"))
    new = ranked_within(names, ["slug"], ["ord"], "r").select("slug", F.col("r").cast("long").alias("at"), F.lit(0).alias("held"), F.col("ord").cast("long").alias("tie"), "display_name")
    placed = ranked_within(new.unionByName(gaps), ["slug"], ["at", "held", "tie"], "number").where("held = 0")
    numbered = F.when(F.col("number") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("number").cast("string")))
    return placed.select(numbered.alias("person_id"), "display_name", "slug", F.col("tie").alias("ord"))


def create_people(people: DataFrame, names: DataFrame) -> DataFrame:
    """(person_id, display_name) of new people: the slug of the name, with -2, -3 and so
    on where it is taken already or by another new one. Names (display_name, ord) come in
    the order of the whole number `ord`, one for each; those that leave no slug get a null
    id. Any number of people may share a name.

    The ids are those of people made one after another. Where the numbered id of one name
    is the plain slug of another, the earlier one has it; from the first one on that must
    yield, all whose slugs differ in numbers at their end only are numbered again. That
    takes no more rounds than there are such slugs of one name."""
    made = settled(names.select("display_name", F.col("ord").cast("long").alias("ord"), slug(F.col("display_name")).alias("slug")))
    nameless = F.coalesce("slug", F.lit("")) == ""
    out, taken, left = made.where(nameless).select(F.lit(None).cast("string").alias("person_id"), "display_name"), people.select("person_id"), made.where(~nameless)
    while not left.isEmpty():
        given = settled(_numbered(taken, left).withColumn("family", F.regexp_replace("slug", r"(-([2-9]|[1-9]\d+))+$", "")))
        first = given.groupBy("person_id").agg(F.min("ord").alias("ord"))
        yielding = settled(given.join(first, ["person_id", "ord"], "left_anti").groupBy("family").agg(F.min("ord").alias("since")))
        judged = given.join(yielding, "family", "left")
        kept = settled(judged.where("since is null or ord < since"))
        out, taken = out.unionByName(kept.select("person_id", "display_name")), taken.unionByName(kept.select("person_id"))
        left = settled(judged.where("ord >= since").select("display_name", "ord", "slug"))
    return out


def delete_person(people: DataFrame, person_id: str, edits: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people left, stored parses that nobody names any more): the person goes, shared
    parses stay, for others may have them too."""
    left = people.where(F.col("person_id") != person_id)
    named = edits.join(left.select("person_id"), "person_id", "left_semi").select("sha")
    return left, orphans(stored, left.select(F.col("active_sha").alias("sha")), named)


def active_person(pointer: DataFrame, people: DataFrame) -> DataFrame:
    """(person_id) that the pointer names, if there is such a person and the id is a
    valid one; no row otherwise, as if nobody had been chosen."""
    return pointer.where(valid_id(F.col("person_id"))).select("person_id").distinct().join(people.select("person_id"), "person_id", "left_semi")


def resolve_person(requests: DataFrame, people: DataFrame) -> DataFrame:
    """Who a request is for: the one it asks for, who must exist; else the active
    one; else the only one. (request_id, person_id, error)."""
    known = people.select(F.col("person_id").alias("asked"), F.lit(True).alias("there"))
    active = people.select(F.col("person_id").alias("active"), F.lit(True).alias("alive"))
    only = people.agg(F.when(F.count("*") == 1, F.first("person_id")).alias("only"))
    rows = requests.join(known, "asked", "left").join(active, "active", "left").join(F.broadcast(only))  # one row
    person = F.when(F.col("asked").isNotNull(), F.when(F.col("there"), F.col("asked"))).otherwise(F.coalesce(F.when(F.col("alive"), F.col("active")), F.col("only")))
    error = F.when(F.col("asked").isNotNull() & F.col("there").isNull(), "unknown_person").when(person.isNull(), "no_person")
    return rows.select("request_id", person.alias("person_id"), error.alias("error"))
