"""Many LIKE patterns against many names, without comparing all with all.

A name has a posting for each of its grams, runs of some lengths of code points; a mark ahead of
the name and one behind it count as code points, so the beginning and the end have grams of
their own.  A pattern's literal runs have grams too, and a name that it matches has all of
them.  Each pattern therefore waits at one gram only, of its longest grams the one with fewest
names, meets the names there by equality, and is then verified with LIKE.

Postings are hashes of a gram and of its name: equal hashes of different grams make candidates,
and names of equal hash share a posting; LIKE decides.  Lengths grow beyond ``gram``, or the
names at a gram, and with them the candidates of each pattern, would grow with the names.

Patterns of wildcards alone have no grams.  Any name of a fitting length matches them, so those
rows are themselves as many as their pairs: they meet names by length, in tiles of bounded size
on both sides, and nothing but the pairs grows with the product.

Spark estimates exploded rows by the files they come from.  Every join here is therefore a sort
merge join: by its estimate a side of many times that size would be broadcast by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.joins import _hashable, keyed_join

_START, _END = "\u0002", "\u0003"  # in a name they only make it a candidate more often
_TILE = 4096  # rows of either side that meet in one tile, about
# A run of literal code points, escaped or plain, and what may follow a backslash.
_LITERALS = r"((?:[^%_\\]|\\[%_\\])+)"
_MALFORMED = r"^(?:[^\\]|\\[%_\\])*\\(?:[^%_\\]|\z)"


def _wrapped(c: Column) -> Column:
    return F.concat(F.lit(_START), c, F.lit(_END))


def _grams(text: Column, size: Column | int) -> Column:
    """All runs of ``size`` code points."""
    size = F.lit(size) if isinstance(size, int) else size
    places = F.length(text) - size + 1
    return F.when(places > 0, F.transform(F.sequence(F.lit(1), places), lambda at: F.substring(text, at, size)))


def _runs(pattern: Column) -> Column:
    """The literal runs of a pattern between its marks, as they stand in a name; a mark alone is none."""
    found = F.regexp_extract_all(_wrapped(pattern), F.lit(_LITERALS), 1)
    plain = F.transform(found, lambda run: F.regexp_replace(run, r"\\(.)", "$1"))
    alone = lambda run, at: ((at == 0) & (run == _START)) | ((at == F.size(found) - 1) & (run == _END))
    return F.filter(plain, lambda run, at: ~alone(run, at))


def _verdict(pattern: Column) -> Column:
    return (
        F.when(pattern.isNull(), "EMPTY").when(pattern.rlike("(?s)" + _MALFORMED), "MALFORMED")
        .when(F.size(_runs(pattern)) == 0, "NO_LITERAL").otherwise("OK")
    )


def pattern_verdicts(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """``patterns`` with a ``verdict`` of how they can be looked up.

    OK: by a gram.  NO_LITERAL: wildcards alone, which any name of a fitting length matches.
    MALFORMED: a backslash ahead of anything but a wildcard or a backslash.  EMPTY: null.
    """
    return patterns.withColumn("verdict", _verdict(F.col(f"`{pattern}`")))


def match_patterns(
    names: DataFrame,
    patterns: DataFrame,
    name: str = "name",
    pattern: str = "pattern",
    gram: int = 3,
    wildcards: bool = False,
) -> DataFrame:
    """Every row of ``patterns`` with every row of ``names`` that is LIKE it, in the columns of both.

    ``%`` stands for any run and ``_`` for one code point; a backslash makes either, or itself,
    literal.  Patterns of verdict OK are looked up (see ``pattern_verdicts``), and with
    ``wildcards`` those of wildcards alone as well; each of these has a row for every name of
    a fitting length, so who asks for them asks for that many rows.  Null names match nothing.
    Repeated names and patterns are looked up by a gram once and then joined back to their rows,
    so a row occurs as often as its pairs do.  The tables must not share column names.
    """
    clash = set(names.columns) & set(patterns.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    pairs = _pairs_by_gram(names.select(F.col(f"`{name}`").alias("name")), patterns.select(F.col(f"`{pattern}`").alias("pattern")), gram)
    pairs = pairs.select(F.col("name").alias("__name"), F.col("pattern").alias("__pattern"))
    rows = keyed_join(patterns.withColumn("__pattern", F.col(f"`{pattern}`")), _merged(pairs), ["__pattern"], "inner")
    joined = keyed_join(rows, _merged(names.withColumn("__name", F.col(f"`{name}`"))), ["__name"], "inner")
    found = joined.select(*[f"`{c}`" for c in patterns.columns], *[f"`{c}`" for c in names.columns])
    return found.union(_pairs_by_length(names, patterns, name, pattern)) if wildcards else found


def _merged(side: DataFrame) -> DataFrame:
    return side.hint("merge")


def _sizes(gram: int) -> list[int]:
    """Lengths of grams: all up to twice ``gram``, then doubled three times."""
    return [*range(1, 2 * gram + 1), *(gram * 2**k for k in range(2, 5))]


def matching_pairs(names: DataFrame, patterns: DataFrame, gram: int = 3) -> DataFrame:
    """The distinct (``pattern``, ``name``) where the name is LIKE the pattern, be it of wildcards alone."""
    return _pairs_by_gram(names, patterns, gram).union(_pairs_by_length(names.distinct(), patterns.distinct(), "name", "pattern"))


def _pairs_by_length(names: DataFrame, patterns: DataFrame, name: str, pattern: str) -> DataFrame:
    """Every row of ``patterns`` of wildcards alone with every row of ``names`` of a fitting length.

    The rows of a length are dealt into tiles by a hash of the row, on either side over as many as
    its rows need, and each share of one side goes to every share of the other.  A tile is a key
    of an equality join; there are no candidates besides the pairs.
    """
    c = F.col(f"`{pattern}`")
    spaces = [
        table.withColumn("__dealt", F.xxhash64(*[F.col(f"`{x}`") for x, kind in table.dtypes if _hashable(kind)]))
        for table in (patterns, names)
    ]
    rows = spaces[0].where(_verdict(c) == "NO_LITERAL").select(
        "*", F.length(F.replace(c, F.lit("%"), F.lit(""))).alias("__least"), F.contains(c, F.lit("%")).alias("__more")
    )
    texts = spaces[1].where(F.col(f"`{name}`").isNotNull()).withColumn("__length", F.length(f"`{name}`"))
    # two arrays, of as many entries as there are lengths
    kinds = rows.groupBy("__least", "__more").agg(F.count("*").alias("rows"))
    kinds = kinds.agg(F.collect_list(F.struct(F.col("__least").alias("least"), F.col("__more").alias("more"), "rows"))).scalar()
    lengths = texts.groupBy("__length").agg(F.count("*").alias("rows"))
    lengths = lengths.agg(F.collect_list(F.struct(F.col("__length").alias("length"), "rows"))).scalar()

    def fits(length: Column, least: Column, more: Column) -> Column:
        return (length == least) | (more & (length > least))

    def shares(count: Column) -> Column:
        return F.ceil(count / F.lit(_TILE))

    def wanted(length: Column) -> Column:
        """Rows of patterns that a length fits."""
        fitting = F.filter("__kinds", lambda k: fits(length, k["least"], k["more"]))
        return F.aggregate(fitting, F.lit(0).cast("bigint"), lambda total, k: total + k["rows"])

    def every(count: Column) -> Column:
        return F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)))

    tile, n = ["__length", "__row_share", "__text_share"], int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        rows.withColumn("__lengths", lengths).withColumn("__kinds", kinds)
        .withColumn("__fit", F.explode(F.filter("__lengths", lambda x: fits(x["length"], F.col("__least"), F.col("__more")))))
        .withColumn("__length", F.col("__fit")["length"])
        .withColumn("__row_share", F.pmod(F.col("__dealt"), shares(wanted(F.col("__length")))))
        .withColumn("__text_share", every(shares(F.col("__fit")["rows"])))
        .select(*[f"`{x}`" for x in patterns.columns], *tile)
    )
    texts = (
        texts.withColumn("__lengths", lengths).withColumn("__kinds", kinds)
        .withColumn("__alike", F.filter("__lengths", lambda x: x["length"] == F.col("__length"))[0]["rows"])
        .withColumn("__text_share", F.pmod(F.col("__dealt"), shares(F.col("__alike"))))
        .withColumn("__row_share", every(shares(wanted(F.col("__length")))))
        .select(*[f"`{x}`" for x in names.columns], *tile)
    )
    # The tiles are small and their pairs many, so partitions must not be put together by the size of the tiles.
    met = rows.repartition(n, *tile).join(_merged(texts.repartition(n, *tile)), tile)
    return met.select(*[f"`{x}`" for x in patterns.columns], *[f"`{x}`" for x in names.columns])


def _pairs_by_gram(names: DataFrame, patterns: DataFrame, gram: int) -> DataFrame:
    """The distinct pairs of patterns that have a literal."""
    sizes = _sizes(gram)
    longest = F.array_max(F.transform("runs", lambda run: F.length(run)))
    usable = (
        pattern_verdicts(patterns.distinct()).where("verdict = 'OK'").select("pattern", _runs(F.col("pattern")).alias("runs"))
        .select("pattern", "runs", F.greatest(*[F.when(longest >= n, n).otherwise(1) for n in sizes]).alias("size"))
    )
    wanted = usable.select(
        "pattern", F.explode(F.array_distinct(_hashed(F.transform("runs", lambda run: _grams(run, F.col("size")))))).alias("gram")
    )
    used = usable.agg(F.collect_set("size")).scalar()  # no postings of lengths that no pattern waits at
    texts = names.where("name IS NOT NULL").groupBy(F.xxhash64("name").alias("id")).agg(F.collect_set("name").alias("names"))

    def of_name(text: Column) -> Column:
        return _hashed(F.array(*[F.when(F.array_contains("used", n), _grams(_wrapped(text), n)) for n in sizes]))

    postings = texts.withColumn("used", used).select(
        "id", F.explode(F.array_distinct(F.flatten(F.transform("names", of_name)))).alias("gram")
    )
    lengths = postings.groupBy("gram").agg(F.count("*").alias("names"))
    # a gram that no name has rules its pattern out
    rarest = (
        keyed_join(wanted, _merged(lengths), ["gram"], "left")
        .groupBy("pattern").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("at"))
        .where("at.names > 0").select("pattern", F.col("at.gram").alias("gram"))
    )
    met = postings.join(_merged(rarest), "gram").select("id", "pattern")
    return (
        keyed_join(met, _merged(texts), ["id"], "inner").select("pattern", F.explode("names").alias("name"))
        .where(F.like("name", F.col("pattern"), F.lit("\\")))
    )


def _hashed(grams: Column) -> Column:
    """The hashes of arrays of grams in one array; null arrays have none."""
    return F.transform(F.flatten(F.filter(grams, lambda found: found.isNotNull())), lambda g: F.xxhash64(g))
