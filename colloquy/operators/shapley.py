"""Exact Shapley values: of small games as joins of their coalition tables, of coverage games of any size in closed form."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coalitions(games: DataFrame, most: int = 16) -> DataFrame:
    """game, players, mask: every coalition of each game (game, players); raises for more players than `most`."""
    held = F.when(F.col("players") > most, F.raise_error(F.lit(f"more than {most} players")).cast("int")).otherwise(F.col("players").cast("int"))
    return games.select("game", "players", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), held).cast("int") - 1)).alias("mask"))


def shapley(values: DataFrame, most: int = 16) -> DataFrame:
    """game, player (from 0) and phi from the worth v of every coalition (game, players, mask, v)."""
    weights = F.create_map(*[F.lit(x) for n in range(1, most + 1) for s in range(n) for x in (n * 100 + s, factorial(s) * factorial(n - s - 1) / factorial(n))])
    without = values.select("game", "players", "mask", "v", F.explode(F.sequence(F.lit(0), F.col("players").cast("int") - 1)).alias("player")).where(F.expr("(mask & shiftleft(1, player)) = 0"))
    joined = without.withColumn("with", F.expr("mask | shiftleft(1, player)")).join(values.select("game", F.col("mask").alias("with"), F.col("v").alias("v_with")), ["game", "with"])
    weight = weights[(F.col("players") * 100 + F.bit_count("mask")).cast("int")]
    return joined.groupBy("game", "player").agg(F.round(F.sum(weight * (F.col("v_with") - F.col("v"))), 9).alias("phi"))


def coverage(members: DataFrame, terms: DataFrame) -> DataFrame:
    """game, player and phi of games whose worth is the number of distinct terms: each is shared equally among the players that have it.

    members (game, player), terms (game, player, term); players without terms get 0, rows without a game none.
    """
    shared = terms.where("game is not null").groupBy("game", "term").agg(F.collect_set("player").alias("owners")).select("game", F.explode("owners").alias("player"), (1 / F.size("owners")).alias("part"))
    sums = shared.groupBy("game", "player").agg(F.sum("part").alias("phi"))
    return members.where("game is not null").select("game", "player").distinct().join(sums, ["game", "player"], "left").select("game", "player", F.round(F.coalesce("phi", F.lit(0.0)), 9).alias("phi"))
