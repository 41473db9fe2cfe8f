"""Feature rows of records, with vocabularies that are fitted on training rows only."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C

#: The elements of organic records, the task of records without one, size classes.
ORGANIC = ["C", "H", "N", "O", "F", "P", "S", "Cl", "Br", "I"]
NO_TASK = "UNKNOWN"
SCALES = ["S", "M", "L", "XL", "unknown"]
#: Vocabularies are literals of a plan; more words than that are refused.
MOST_WORDS = 2000


@dataclasses.dataclass(frozen=True)
class Vocabulary:
    elements: tuple[str, ...]
    tasks: tuple[str, ...]


def task_of() -> Column:
    return F.coalesce(F.nullif("task_type", F.lit("")), F.lit(NO_TASK))


def fit(train: DataFrame, organic: bool = False) -> Vocabulary:
    """The elements and tasks of training records, sorted; organic records have fixed elements."""
    words = train.select(F.explode(C.elements_or_none(F.col("elements"))).alias("w")).distinct()
    tasks = train.select(task_of().alias("w")).distinct()
    found = [sorted(r.w for r in df.limit(MOST_WORDS + 1).collect() if r.w is not None) for df in (words, tasks)]
    if max(map(len, found)) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} different words")
    return Vocabulary(tuple(ORGANIC if organic else found[0]), tuple(found[1]))


def names(vocabulary: Vocabulary, scale: bool = True) -> list[str]:
    fixed = ["log1p_n_atoms", "charge", "mult_ne_1", "has_solvent"]
    return fixed + [f"elem_{e}" for e in vocabulary.elements] + [f"task_{t}" for t in vocabulary.tasks] + ([f"scale_{b}" for b in SCALES] if scale else [])


def row(vocabulary: Vocabulary, scale: bool = True) -> Column:
    """A record's features as an array of doubles, in the order of `names`. Nulls count as 0, 1 for the
    multiplicity, no solvent, no elements and no task; words that training lacks have no place."""
    n = F.coalesce("n_atoms", F.lit(0))
    e = F.coalesce(C.elements_or_none(F.col("elements")), F.array().cast("array<string>"))
    mult = F.coalesce(F.nullif("multiplicity", F.lit(0)), F.lit(1))
    cols = [F.log1p(F.greatest(n, F.lit(0)).cast("double")), F.coalesce("charge", F.lit(0)).cast("double"), (mult != 1).cast("double"), (F.trim(F.coalesce("solvent", F.lit(""))) != "").cast("double")]
    cols += [F.array_contains(e, x).cast("double") for x in vocabulary.elements]
    cols += [(task_of() == t).cast("double") for t in vocabulary.tasks]
    if scale:
        size = C.scale_bucket(F.col("n_atoms"))
        cols += [(size == b).cast("double") for b in SCALES]
    return F.array(*cols)


def transform(records: DataFrame, vocabulary: Vocabulary, keep: list[str], scale: bool = True) -> DataFrame:
    """keep and features."""
    return records.select(*keep, row(vocabulary, scale).alias("features"))


def cross_validated(records: DataFrame, fold: str, folds: int, keep: list[str], organic: bool = False) -> DataFrame:
    """keep, split_fold, is_test, features: for each fold its test rows and its training rows, with the
    vocabulary of the training rows."""
    out = None
    for k in range(folds):
        vocabulary = fit(records.where(F.col(fold) != k), organic)
        part = records.select(*dict.fromkeys([*keep, fold]), F.lit(k).alias("split_fold"), (F.col(fold) == k).alias("is_test"), row(vocabulary).alias("features"))
        out = part if out is None else out.unionByName(part)
    return out


def representative(species: DataFrame, by: list[str], size: str, pos: str) -> DataFrame:
    """The species with the most atoms of each reaction, the first of equals."""
    order = F.struct((-F.coalesce(F.col(size), F.lit(-1))).alias("n"), F.col(pos))
    best = species.groupBy(*by).agg(F.min_by(F.struct(*species.columns), order).alias("s"))
    return best.select("s.*")


def profile(representatives: DataFrame, cell: Column, keep: list[str]) -> DataFrame:
    """What a method is asked for: the representative's elements, size, charge and spin, as a single point."""
    system = C.system_type(F.col("elements"), F.col("multiplicity"))
    return representatives.select(*keep, "elements", "n_atoms", "charge", "multiplicity", F.lit("SP").alias("task_type"), system.alias("system_type"), cell.alias("specialist_cell"))


def xyz_elements(xyz: Column) -> Column:
    """How many atoms of each element an XYZ text's lines have, as a map."""
    lines = F.filter(F.split(F.trim(xyz), "\n"), lambda x: F.trim(x) != "")
    first = F.transform(lines, lambda x: F.element_at(F.split(F.trim(x), r"\s+"), 1))
    kinds = F.array_sort(F.array_distinct(first))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(first, lambda x: x == k))))


def unsaturation(counts: Column) -> Column:
    """(2 C + 2 + N - H - F) / 2 of a map of counts."""
    n = lambda e: F.coalesce(F.try_element_at(counts, F.lit(e)), F.lit(0))
    return (2 * n("C") + 2 + n("N") - n("H") - n("F")) / 2.0


def other_elements(counts: Column) -> Column:
    """Indicators has_X of the elements beyond C, H, N, O and F, as a map."""
    kinds = F.filter(F.map_keys(counts), lambda k: ~k.isin("C", "H", "N", "O", "F"))
    return F.map_from_arrays(F.transform(kinds, lambda k: F.concat(F.lit("has_"), k)), F.transform(kinds, lambda k: F.lit(1.0)))


def clean_vocabulary(records: DataFrame, fields: list[str]) -> DataFrame:
    """field, values: the distinct values of each field in order, without nulls, empties and those with `=`."""
    pairs = F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields)))
    rows = records.select(pairs).where("value <> ''").where(~F.contains("value", F.lit("=")))
    return rows.groupBy("field").agg(F.array_sort(F.collect_set("value")).alias("values"))


def canonical_predictions(predictions: DataFrame, by: list[str], functional: str, basis: str, canonical) -> DataFrame:
    """Predictions with canonical(functional); those that have none left, or no basis, go."""
    rows = predictions.withColumn(functional, canonical(F.nullif(functional, F.lit(""))))
    return rows.where(F.col(functional).isNotNull() & (F.coalesce(basis, F.lit("")) != "")).select(*by, functional, basis)


def first_hit(hits: DataFrame, functional: str, basis: str) -> DataFrame:
    """query_id and the first hit's pair; null where either is missing. hits: query_id, rank and the pair."""
    whole = (F.coalesce(functional, F.lit("")) != "") & (F.coalesce(basis, F.lit("")) != "")
    return hits.where("rank = 1").select("query_id", F.when(whole, F.struct(functional, basis)).alias("pair"))
