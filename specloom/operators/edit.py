"""Edit distances between token sequences of the same model: of all pairs, or ring by ring around some of them.

Two sequences that are ``d`` edits apart have all but ``d`` of the longer one's tokens in common, as bags. So if each bag is sorted in one order, rare tokens first, their first
d + 1 tokens have one in common: pairs are looked for by an equi-join on these, and only pairs found so are compared. Sequences of at most ``d`` tokens are
near each other whatever they hold, and meet under an element of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import token_codes


def confusion(sequences: DataFrame) -> DataFrame:
    """Rows (model_id, a, b, d) for all pairs of sequences (model_id, path_id, tokens) of a model, itself included. Half of the pairs
    are computed, by the built-in distance of strings with a character for each token."""
    alphabet = sequences.groupBy("model_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("alphabet"))
    coded = sequences.join(alphabet, "model_id").select("model_id", "path_id", token_codes(F.col("tokens"), F.col("alphabet")).alias("c"))
    x, y = (coded.select("model_id", F.col("path_id").alias(n), F.col("c").alias(f"c_{n}")) for n in "ab")
    half = x.join(y, "model_id").where("a < b").select("model_id", "a", "b", F.levenshtein("c_a", "c_b").alias("d"))
    own = coded.select("model_id", F.col("path_id").alias("a"), F.col("path_id").alias("b"), F.lit(0).alias("d"))
    return half.union(half.select("model_id", F.col("b").alias("a"), F.col("a").alias("b"), "d")).union(own)


def merge_order(distances: DataFrame) -> DataFrame:
    """Rows (model_id, a, b, place): the order in which a sequence meets the others, by distance, then number."""
    place = F.row_number().over(Window.partitionBy("model_id", "a").orderBy("d", "b")) - 1
    return distances.select("model_id", "a", "b", place.alias("place"))


def indexed(sequences: DataFrame) -> DataFrame:
    """Rows (model_id, path_id, c, bag) of sequences (model_id, path_id, tokens): the tokens as a string of codes, and as a sorted bag, where the rare ones come first and
    repeated ones are numbered."""
    one = sequences.select("model_id", F.explode("tokens").alias("token")).groupBy("model_id", "token").agg(F.count("*").alias("n"))
    alphabet = one.groupBy("model_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("alphabet"))
    c = sequences.join(alphabet, "model_id", "left").select("model_id", "path_id", F.coalesce(token_codes(F.col("tokens"), F.col("alphabet")), F.lit("")).alias("c"), F.transform("tokens", lambda t: F.array_position("alphabet", t).cast("int")).alias("codes"))
    codes = F.array_sort("codes")
    numbered = F.transform(codes, lambda x, i: F.struct(x.alias("code"), (i - F.array_position(codes, x).cast("int")).alias("nth")))
    return c.select("model_id", "path_id", "c", numbered.alias("bag"))


def ring(some: DataFrame, index: DataFrame, d: int) -> DataFrame:
    """Rows (model_id, a, b): for sequences (model_id, path_id) of ``some`` those of ``index`` at edit distance ``d`` exactly, themselves included for 0."""
    short = F.struct(F.lit(-1).alias("code"), F.lit(0).alias("nth"))
    first = F.slice("bag", 1, d + 1)
    keys = index.select("model_id", "path_id", "c", F.explode(F.when(F.size("bag") <= d, F.concat(first, F.array(short))).otherwise(first)).alias("e"))
    a = keys.join(some.select("model_id", "path_id"), ["model_id", "path_id"], "left_semi").select("model_id", F.col("path_id").alias("a"), F.col("c").alias("c_a"), "e")
    b = keys.select("model_id", F.col("path_id").alias("b"), F.col("c").alias("c_b"), "e")
    near = a.join(b, ["model_id", "e"]).where(F.abs(F.length("c_a") - F.length("c_b")) <= d).drop("e").distinct()
    return near.where(F.levenshtein("c_a", "c_b", d) == d).select("model_id", "a", "b")
