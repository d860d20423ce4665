"""Name screening against sanctions and PEP lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientlens.common import round_half_up

# Lists consulted and sources of PEP data.
LISTS_CHECKED = ("OFAC", "UN", "EU", "UK_HMT", "SG_MAS")
SCREENING_SOURCES = ("World-Check", "Dow Jones", "Refinitiv")

MAX_DISTANCE = 3


def normalise_name(name: Column) -> Column:
    """Upper case with every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]+", " "))


def deletion_keys(name: Column, max_distance: int, longer: Column, is_name: bool) -> Column:
    """Hashes of the name with characters removed: of two names within the edit distance, all pairs but those of :func:`place_keys` share one.

    Of d edits, s replace, i insert and r remove: one name loses s + r characters, the other s + i, and what is left is
    the same. If both lose d, all edits replace. If one of them loses d and the other less, the first is the longer one:
    its keys of d removals go by their own number, and are made only where ``longer`` holds, as no shorter name could
    meet them otherwise.
    """
    def without_one(text: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(text)),
                           lambda i: F.concat(F.substring(text, 1, i - 1), F.substring(text, i + 1, F.length(text))))

    def shorter(level: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(F.filter(level, lambda t: F.length(t) > 0), without_one)))

    def hashes(level: Column, kind: int) -> Column:
        return F.transform(level, lambda k: F.xxhash64(F.lit(kind), k))

    level = F.array(name)
    few = level
    for _ in range(max_distance - 1):
        level = shorter(level)
        few = F.concat(few, level)
    mine, other = (1, 2) if is_name else (2, 1)
    most = F.when(longer, hashes(shorter(level), mine)).otherwise(F.array().cast("array<bigint>"))
    few = F.array_distinct(few)
    return F.array_distinct(F.concat(hashes(few, 0), hashes(few, other), most))


def place_keys(name: Column, max_distance: int) -> Column:
    """Hashes of the name without every choice of ``max_distance`` places, and the places.

    Two names that differ in exactly these places, and nowhere else, share one such key, no others.
    """
    return F.transform(_cuts(name, max_distance), lambda c: F.xxhash64(c["text"], c["places"]))


def _cuts(name: Column, removed: int) -> Column:
    """(text, places, at) of every choice of ``removed`` places: the name without them, the places, and the first of them."""
    start = F.array(F.struct(name.alias("text"), F.lit("").alias("places"), (F.length(name) + 1).alias("at")))

    def earlier(cut: Column) -> Column:
        # Places are removed from the back, so that those before keep their numbers.
        places = F.filter(F.sequence(F.lit(0), cut["at"] - 1), lambda p: p > 0)
        return F.transform(places, lambda p: F.struct(
            F.concat(F.substring(cut["text"], F.lit(1), p - 1), F.substring(cut["text"], p + 1, F.length(cut["text"]))).alias("text"),
            F.concat(cut["places"], F.lit(" "), p.cast("string")).alias("places"), p.alias("at")))

    for _ in range(removed):
        start = F.flatten(F.transform(start, earlier))
    return start


def matching_names(names: DataFrame, listed: DataFrame, max_distance: int) -> DataFrame:
    """(name, listed, distance) for all distinct pairs within the edit distance."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"max_distance must be 0 to {MAX_DISTANCE}")
    if max_distance == 0:
        return names.join(listed, F.col("name") == F.col("listed")).select("name", "listed", F.lit(0).alias("distance"))

    # Each name has hundreds of keys, which the estimated sizes do not know: no side may be broadcast. Names are few bytes
    # and much work: they are spread by number, not by size.
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(column).repartition(tasks)

    def keyed(df: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
        # Lengths are a few numbers, which tell whether a slightly shorter name exists on the other side.
        lengths = others.agg(F.collect_set(F.length(other)).alias("lengths")).scalar()
        size = F.length(column)
        longer = F.exists("_lengths", lambda n: (n < size) & (n >= size - max_distance))
        return spread(df, column).withColumn("_lengths", lengths).select(
            column, F.explode(deletion_keys(F.col(column), max_distance, longer, column == "name")).alias("_key"))

    def placed(df: DataFrame, column: str) -> DataFrame:
        return spread(df, column).select(column, F.explode(place_keys(F.col(column), max_distance)).alias("_key"))

    differing = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))),
                                lambda i: F.substring("name", i, 1) != F.substring("listed", i, 1)))
    # Pairs that replace max_distance characters meet once, so only the few others must be made distinct.
    replaced = (placed(names, "name").join(placed(listed, "listed").hint("merge"), "_key")
                .where(F.levenshtein("name", "listed", max_distance - 1) < 0)
                .select("name", "listed", F.lit(max_distance).alias("distance")))
    others = (keyed(names, "name", listed, "listed").join(keyed(listed, "listed", names, "name").hint("merge"), "_key")
              .select("name", "listed").distinct()
              .withColumn("distance", F.levenshtein("name", "listed", max_distance))
              .where((F.col("distance") >= 0) & ~((F.col("distance") == max_distance)
                                                  & (F.length("name") == F.length("listed")) & (differing == max_distance))))
    return replaced.union(others)


def _scored_names(customers: DataFrame, watchlist: DataFrame, max_distance: int) -> DataFrame:
    """Distinct names with each distinct (list, listed name, country) entry they match and its score.

    Distinct names are compared, not customers, so neither a name shared by many
    customers nor one listed many times multiplies the work.
    """
    names = customers.select(normalise_name(F.col("name")).alias("name")).distinct()
    entries = watchlist.select(normalise_name(F.col("listed_name")).alias("listed"), "list_name",
                               F.col("country").alias("listed_country")).distinct()
    pairs = matching_names(names, entries.select("listed").distinct(), max_distance)
    longest = F.greatest(F.length("name"), F.length("listed"), F.lit(1))
    return (pairs.withColumn("score", round_half_up(1 - F.col("distance") / longest, 4)).join(entries, "listed")
            .withColumnRenamed("name", "_name"))


def _named(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", "name", F.col("jurisdiction").alias("country"),
                            normalise_name(F.col("name")).alias("_name"))


def screening_matches(customers: DataFrame, watchlist: DataFrame, max_distance: int = 1) -> DataFrame:
    """One row per customer and matching entry: the details behind :func:`screen_names`.

    ``same_country`` tells whether the entry's country is the customer's; null
    where one of them is not known.
    """
    return (_named(customers).join(_scored_names(customers, watchlist, max_distance), "_name")
            .select("customer_id", "name", "country", "list_name", "listed", "listed_country", "score",
                    (F.col("country") == F.col("listed_country")).alias("same_country")))


def screen_names(customers: DataFrame, watchlist: DataFrame, max_distance: int = 1) -> DataFrame:
    """One row per customer with the number of matching entries and the best score.

    Only counts per distinct name are joined to the customers; a match list of
    any length is in :func:`screening_matches`.
    """
    best = _scored_names(customers, watchlist, max_distance).groupBy("_name").agg(
        F.count("*").alias("matches_found"), F.max("score").alias("screening_score"))
    return (_named(customers).join(best, "_name", "left").select(
        "customer_id", "name", "country",
        F.col("matches_found").isNotNull().alias("match_found"),
        F.coalesce("matches_found", F.lit(0)).alias("matches_found"),
        F.coalesce("screening_score", F.lit(0.0)).alias("screening_score"),
        F.array(*[F.lit(x) for x in LISTS_CHECKED]).alias("lists_checked"),
        F.when(F.col("screening_score") == 1, "BLOCK - Exact sanctions match")
        .when(F.col("matches_found").isNotNull(), "REVIEW - Potential sanctions matches found")
        .otherwise("CLEAR - No sanctions matches found").alias("recommendation")))


def check_pep(customers: DataFrame, pep_list: DataFrame, relations: DataFrame) -> DataFrame:
    """PEP status by normalised name, and links to PEPs through ``relations``.

    ``relations`` holds (customer_id, related_name, strength). A customer is a
    close associate when one link to a PEP has strength 2 or more.
    """
    peps = (pep_list.groupBy(normalise_name(F.col("pep_name")).alias("_name"))
            .agg(F.min("category").alias("pep_category")))
    linked = (relations.withColumn("_name", normalise_name(F.col("related_name")))
              .join(peps.select("_name"), "_name", "left_semi")
              .groupBy("customer_id").agg(F.max("strength").alias("_strength")))
    return (customers.select("customer_id", "name", normalise_name(F.col("name")).alias("_name"))
            .join(peps, "_name", "left").join(linked, "customer_id", "left")
            .select("customer_id", "name",
                    F.col("pep_category").isNotNull().alias("pep_status"),
                    "pep_category",
                    F.col("_strength").isNotNull().alias("related_pep"),
                    F.coalesce(F.col("_strength") >= 2, F.lit(False)).alias("close_associate"),
                    F.array(*[F.lit(s) for s in SCREENING_SOURCES]).alias("screening_sources"),
                    F.when(F.col("pep_category").isNotNull(), "PEP - Enhanced due diligence required")
                    .when(F.col("_strength").isNotNull(), "Related to a PEP - Review required")
                    .otherwise("No PEP indicators found").alias("recommendation")))
