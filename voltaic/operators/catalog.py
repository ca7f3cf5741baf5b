"""File catalogs: entities of file names, and joins on entities where unknown matches anything.

A catalog is a table of paths; its entities are columns and maps made from the path, so filters on them prune before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entities in the order of file names, and longer names of two of them.
ORDER = (
    "sub", "tpl", "ses", "cohort", "sample", "task", "tracksys", "acq", "nuc", "voi", "ce", "trc", "stain", "rec", "dir", "run", "mod", "echo",
    "flip", "inv", "mt", "part", "proc", "hemi", "space", "split", "recording", "chunk", "atlas", "seg", "scale", "res", "den", "label", "desc",
)
ALIASES = {"subject": "sub", "session": "ses"}
KEYS = ("sub", "ses", "task", "run")
#: What says nothing of how special a file is, and what files never count as sharing.
NOT_SPECIFIC = ("suffix", "extension", "datatype", "scope")
NOT_SHARED = ("suffix", "extension", "datatype", "desc", "description")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.element_at(F.split(file_name(path), r"\."), 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"^[^.]*(\..*)$", 1)


def suffix(path: Column) -> Column:
    """The last part of the stem, if it is no entity."""
    last = F.element_at(F.split(stem(path), "_"), -1)
    return F.when(~last.contains("-"), last)


def datatype(path: Column) -> Column:
    """The folder that the file is in."""
    return F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)


def entities(path: Column) -> Column:
    """Map of the stem's parts key-value, by short names; of one key the first counts."""
    parts = F.filter(F.split(stem(path), "_"), lambda x: x.contains("-"))

    def entry(part: Column) -> Column:
        k = F.substring_index(part, "-", 1)
        return F.struct(F.when(k == "subject", "sub").when(k == "session", "ses").otherwise(k).alias("k"), F.regexp_extract(part, "^[^-]*-(.*)$", 1).alias("v"))

    # One pass: a list that a function given to ``filter`` or ``transform`` looks into is made anew for each part.
    none = F.array().cast("array<struct<k:string,v:string>>")
    first = F.aggregate(F.transform(parts, entry), none, lambda kept, e: F.when(F.exists(kept, lambda x: x["k"] == e["k"]), kept).otherwise(F.array_append(kept, e)))
    return F.map_from_entries(first)


def with_entities(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with entities, suffix, extension, datatype and the four keys as columns."""
    p = F.col(path)
    out = files.withColumns({"entities": entities(p), "suffix": suffix(p), "extension": extension(p), "datatype": datatype(p)})
    return out.withColumns({k: normal_value(F.try_element_at("entities", F.lit(k))) for k in KEYS})


def normal_value(value: Column) -> Column:
    """Empty is unknown; a leading ``sub-`` or ``ses-`` is no part of a value."""
    return F.nullif(F.regexp_replace(value, "^(sub|ses)-", ""), F.lit(""))


def normal_subject(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), "(?i)^sub-", "")


def build_name(found: Column, suffix_: Column, extension_: Column) -> Column:
    """A file name of a map of entities, in the fixed order; entities outside it have no place in a name."""
    known = F.array(*(F.concat(F.lit(f"{k}-"), F.try_element_at(found, F.lit(k))) for k in ORDER))
    return F.concat(F.array_join(F.filter(known, lambda x: x.isNotNull()), "_"), F.lit("_"), suffix_, extension_)


def _mask(keys: tuple[str, ...]) -> Column:
    """Which keys are known, as bits."""
    return sum((F.when(F.col(k).isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))


def compatible_pairs(targets: DataFrame, candidates: DataFrame, path: str = "path", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(target, candidate, score, specificity) of all pairs whose every key is equal or unknown on a side.

    Sides are joined by equality of the keys that both know. Which these are follows from the two masks of known keys, so each row is repeated for the masks
    that occur on the other side (16 at most for four keys).
    """
    t, c = targets.withColumn("_m", _mask(keys)), candidates.withColumn("_m", _mask(keys))
    masks = [[r[0] for r in side.select("_m").distinct().collect()] for side in (t, c)]

    def keyed(side: DataFrame, others: list[int], mine: str, other: str) -> DataFrame:
        rows = side.withColumn("_o", F.explode(F.array(*(F.lit(m) for m in others)))) if others else side.withColumn("_o", F.lit(0)).limit(0)
        both = F.col("_m").bitwiseAND(F.col("_o"))
        values = [F.when(both.bitwiseAND(F.lit(1 << i)) > 0, F.col(k)).otherwise("") for i, k in enumerate(keys)]
        score = sum((F.when(both.bitwiseAND(F.lit(1 << i)) > 0, 1).otherwise(0) for i in range(len(keys))), F.lit(0))
        return rows.select(F.col("_m").alias(mine), F.col("_o").alias(other), F.array(*values).alias("_v"), score.alias("score"), F.col(path).alias("_path"), "entities")

    left = keyed(t, masks[1], "_t", "_c").select("_t", "_c", "_v", "score", F.col("_path").alias("target"))
    right = keyed(c, masks[0], "_c", "_t").select("_t", "_c", "_v", F.col("_path").alias("candidate"), F.size(F.filter(F.map_keys("entities"), lambda k: ~k.isin(*NOT_SPECIFIC))).alias("specificity"))
    return left.join(right, ["_t", "_c", "_v"]).select("target", "candidate", "score", "specificity")


def best_match(targets: DataFrame, candidates: DataFrame, path: str = "path", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """For each target its candidate with most equal keys, and of those with fewest entities; ``ambiguous`` if that leaves several."""
    pairs = compatible_pairs(targets, candidates, path, keys)
    ranked = pairs.withColumn("_r", F.rank().over(Window.partitionBy("target").orderBy(F.col("score").desc(), "specificity"))).where("_r = 1")
    return ranked.groupBy("target").agg(F.min("candidate").alias("candidate"), F.first("score").alias("score"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def shared_entities(files: DataFrame, by: str | None = None, excluded: tuple[str, ...] = NOT_SHARED) -> DataFrame:
    """(key, value) that all files (of a group) have, without the keys that are excluded. Files of an unknown group share nothing."""
    keys = [by] if by else []
    counts = ~F.col("key").isin(*excluded)
    if by:
        counts &= F.col(by).isNotNull()
    # Files are counted in the same pass, by their first rows; what does not count keeps its row, without a key. No filter or join on the group: both would be
    # pushed below the parsing of paths, which is then done again for them.
    rows = files.select(*keys, F.posexplode_outer("entities").alias("_i", "key", "value"))
    rows = rows.select(*keys, F.when(counts, F.col("key")).alias("key"), F.when(counts, F.col("value")).alias("value"), (F.coalesce("_i", F.lit(0)) == 0).alias("_first"))
    values = rows.groupBy(*keys, "key", "value").agg(F.count("key").alias("_k"), F.count_if("_first").alias("_files"))
    # A shared key has one value. With a row a key, a large group's window stays small, however many values it has.
    per_key = values.groupBy(*keys, "key").agg(F.first("value").alias("value"), F.count(F.lit(1)).alias("_values"), F.sum("_k").alias("_k"), F.sum("_files").alias("_files"))
    total = F.sum("_files").over(Window.partitionBy(*keys))
    return per_key.withColumn("_n", total).where("_values = 1 and _k = _n").select(*keys, "key", "value")


def subject_groups(files: DataFrame, path: str = "path") -> DataFrame:
    """One row per subject: its first file and how many it has."""
    return files.groupBy("sub").agg(F.min(path).alias("primary"), F.count(F.lit(1)).alias("n_files"))


def still_to_do(work: DataFrame, done: DataFrame, path: str = "path") -> DataFrame:
    """Work whose output does not exist yet."""
    return work.join(done.select(path).distinct(), path, "left_anti")


def modify_entities(found: Column, changes: dict[str, str | None]) -> Column:
    """A map of entities with some set anew; None takes one away."""
    kept = F.map_filter(found, lambda k, _: ~k.isin(list(changes)))
    new = {k: v for k, v in changes.items() if v is not None}
    return F.map_concat(kept, F.create_map(*(F.lit(x) for kv in new.items() for x in kv))) if new else kept


def matching(files: DataFrame, **wanted: str | list[str] | None) -> DataFrame:
    """Files whose entities are as wanted: a value, one of several, or unknown (None), compared as text."""
    out = files
    for key, value in wanted.items():
        c = F.col(key) if key in files.columns else F.try_element_at("entities", F.lit(key))
        out = out.where(c.isNull() if value is None else c.cast("string").isin([str(v) for v in value] if isinstance(value, list) else [str(value)]))
    return out
