"""Pairs of people that can reach a score, none left out: what their names, dates and parents allow at best is held against it before all their relatives are compared.

Both parents of a pair agree by name, or one agrees by the id of somebody whom a tree lacks, or one parent at least gives no points, so that the pair's own names must be alike. The
first are found by the parents' given names and their own, the second by the id, the third by their own names. Distinct names are compared once, each with each of the other tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..shipping import ship
from . import blocking, compare

#: Rows of a table of pairs of names that each executor gets whole; larger ones are shuffled.
SENT = 1_000_000
#: What sums of points may be off by rounding.
EPS = 1e-9
#: The similarity of equal years without months.
ALONE = 0.9
PARENTS = ("father", "mother")
LAST = ("norm_last", "norm_maiden", "born")


def _sent(pairs: DataFrame) -> DataFrame:
    return F.broadcast(pairs) if pairs.limit(SENT + 1).count() <= SENT else pairs.hint("merge")


def _side(df: DataFrame, p: str) -> DataFrame:
    return df.select([F.col(c).alias(f"{p}_{c}") for c in df.columns])


def _each_with_each(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct names of both trees are few rows and much work, so they are dealt over all cores."""
    return _side(left, "s").repartition(2 * left.sparkSession.sparkContext.defaultParallelism).crossJoin(_side(right, "d"))


class Reach:
    """left and right: people by compare.nameless() with compare.bonuses(), written. Scores below `least` aren't asked for."""

    def __init__(self, left: DataFrame, right: DataFrame, least: float, weights: dict | None, scratch: Scratch):
        ship(left.sparkSession)
        self.weights, self.scratch, self.least = compare.WEIGHTS | (weights or {}), scratch, least
        self.shares = compare._shares(self.weights)
        parent = lambda kind: F.get(F.filter("kin", lambda k: (k["kind"] == kind) & k["known"]), F.lit(0))["f"]
        more = {
            "last_key": F.concat_ws("\x01", *[F.coalesce(c, F.lit("\x02")) for c in LAST]), "kin_key": F.coalesce(compare.kin_text(F.col("kin")), F.lit("")), "has_last": F.col("norm_last").isNotNull(), "has_maiden": F.col("norm_maiden").isNotNull(),
            "kinds": F.array_sort(F.array_distinct(F.coalesce(F.col("kin.kind"), F.array().cast("array<string>")))), **{kind: parent(kind) for kind in PARENTS},
        }
        sides = [df.withColumns(more) for df in (left, right)]
        # what is compared as a text gets a number, so that pairs stay narrow
        keys = ("first_key", "last_key", "kin_key")
        self.codes = {c: scratch.keep(sides[0].select(c).union(sides[1].select(c)).distinct().withColumn("code", F.monotonically_increasing_id()), c) for c in keys}
        slim = ("id", "gender", "place", *compare.YEARS, "has_kin", "has_parents", "has_child", "has_last", "has_maiden", "kinds", *PARENTS)
        self.rows = []
        for df in sides:
            for c, coded in self.codes.items():
                df = df.join(coded.withColumnRenamed("code", c[:-4] + "_no").hint("merge"), c)
            self.rows.append(scratch.keep(df.select(*slim, *[c[:-4] + "_no" for c in keys]), "slim"))
        self.ids = [df.select("id", F.explode("kin").alias("k")).select("id", "k.kind", "k.other", "k.known").where(F.col("kind").isin(*PARENTS)) for df in (left, right)]
        self._facts()
        self.firsts, self.lasts, self.parents = self._firsts(left, right), self._lasts(*sides), self._parents()

    def _facts(self) -> None:
        """The fields and bonuses that pairs can have, and the family that those can have in whom a parent gives no points."""
        some = {"maiden": "has_maiden", "birth": "birth_year IS NOT NULL", "month": "birth_month IS NOT NULL", "place": "place IS NOT NULL", "death": "death_year IS NOT NULL", "parents": "has_parents", "child": "has_child"}
        found = [df.groupBy("kinds").agg(*[F.expr(f"bool_or({x})").alias(c) for c, x in some.items()]).collect() for df in self.rows]
        both = {c: all(any(r[c] for r in rows) for rows in found) for c in some}
        self.counted = {c: x for c, x in self.shares.items() if both.get(c, True)}
        self.birth = 1.0 if both["month"] else ALONE
        self.bonus = (20.0 if both["child"] else 10.0) if both["parents"] else 0.0
        self.part = 0.0
        for a, b in ((set(a["kinds"]), set(b["kinds"])) for a in found[0] for b in found[1]):
            most = sum(compare.KIN[k] for k in a | b)
            agree = sum(compare.KIN[k] for k in a & b) - (compare.KIN["father"] if a & b >= set(PARENTS) else 0)
            self.part = max(self.part, agree / most if most else 0.0)

    def _part(self) -> Column:
        """The family that a pair can have if one parent at least gives no points."""
        has = lambda k: (F.array_contains("s_kinds", k), F.array_contains("d_kinds", k))
        most = sum((F.when(has(k)[0] | has(k)[1], x).otherwise(0.0) for k, x in compare.KIN.items()), F.lit(0.0))
        agree = sum((F.when(has(k)[0] & has(k)[1], x).otherwise(0.0) for k, x in compare.KIN.items()), F.lit(0.0))
        agree -= F.when(has("father")[0] & has("father")[1] & has("mother")[0] & has("mother")[1], compare.KIN["father"]).otherwise(0.0)
        return F.when(most > 0, agree / most).otherwise(0.0)

    def _by_names(self, names: tuple[str, ...], family: float, bonus: float) -> Column:
        """The largest score of pairs of which some names' sims are known."""
        known = [(F.col(f"{c}_sim"), float(self.shares[c])) for c in names]
        points, most = sum((F.coalesce(c * x, F.lit(0.0)) for c, x in known), F.lit(0.0)), sum((F.when(c.isNotNull(), x).otherwise(0.0) for c, x in known), F.lit(0.0))
        rest = float(sum(x for c, x in self.counted.items() if c not in (*names, "birth")) + self.weights["gender"])
        kin, birth = self.weights["family"], self.counted.get("birth", 0.0)
        # years alone never agree in full, so that a pair without them can have more
        return F.greatest(*[100 * (points + rest + x * self.birth + family * kin) / (most + rest + x + kin) for x in (0.0, birth)]) + bonus

    def _by_sims(self, family: Column, bonus: Column) -> Column:
        points, most = compare._points(self.weights, family)
        return 100 * points / most + bonus

    def _firsts(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """s_first_no, d_first_no and first_sim of given names that a pair can have."""
        keys = [df.select("first_key").distinct() for df in (left, right)]
        sims = compare.first_sims(_each_with_each(*keys), left, right).where(self._by_names(("first",), 1.0, self.bonus) >= self.least - EPS)
        for p in "sd":
            sims = sims.join(self.codes["first_key"].select(F.col("first_key").alias(f"{p}_first_key"), F.col("code").alias(f"{p}_first_no")), f"{p}_first_key")
        return self.scratch.keep(sims.select("s_first_no", "d_first_no", "first_sim"), "firsts")

    def _lasts(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """s_last_no, d_last_no, last_sim and maiden_sim of surnames and maiden names that a pair can have."""
        coded = self.codes["last_key"].withColumnRenamed("code", "last_no").hint("merge")
        names = [self.scratch.keep(df.select("last_key", *LAST).distinct().join(coded, "last_key").drop("last_key"), "names") for df in (left, right)]
        sims = _each_with_each(*names).withColumns({f"__{c}": compare.alike(F.col(f"s_norm_{c}"), F.col(f"d_norm_{c}")) for c in ("last", "maiden")})
        sims = sims.select("s_last_no", "d_last_no", compare.last_ladder(F.col("__last")).alias("last_sim"), compare.maiden_ladder(F.col("__maiden")).alias("maiden_sim"))
        return self.scratch.keep(sims.where(self._by_names(("last", "maiden"), 1.0, self.bonus) >= self.least - EPS), "lasts")

    def _parents(self) -> DataFrame:
        """s_name and d_name of parents' given names that may agree."""
        names = [self.scratch.keep(df.select(F.explode(F.array(*PARENTS)).alias("name")).where("name IS NOT NULL").distinct(), "names") for df in self.rows]
        return self.scratch.keep(_each_with_each(*names).where(compare.alike(F.col("s_name"), F.col("d_name")) >= compare.SAME), "parents")

    def _pairs(self, least: float, only: DataFrame | None) -> DataFrame:
        enough = lambda x: x >= least - EPS
        no, of_parents = ("first_no", "last_no"), [F.col(c) for c in PARENTS]
        left, right = self.rows
        if only is not None:
            left = left.join(only.hint("merge"), "id", "left_semi")
        own = sum(self.counted.values()) + self.weights["gender"]
        if 100 * own / (own + self.weights["family"]) < least - EPS:  # without relatives nobody gets so far
            left, right = left.where("has_kin"), right.where("has_kin")
        s, d = _side(left, "s"), _side(right, "d")
        firsts, lasts = self.firsts.where(enough(self._by_names(("first",), 1.0, self.bonus))), _sent(self.lasts.where(enough(self._by_names(("last", "maiden"), 1.0, self.bonus))))
        has = lambda a, b: F.col(f"s_has_{a}") & F.col(f"d_has_{b}")
        given = lambda c: F.when(F.col(f"s_{c}").isNotNull() & F.col(f"d_{c}").isNotNull(), 1.0)
        best = {"last_sim": F.when(has("last", "last") | has("maiden", "last") | has("last", "maiden"), 1.0), "maiden_sim": F.when(has("maiden", "maiden"), 1.0), "birth_sim": compare.event("birth"), "place_sim": given("place"), "death_sim": given("death_year")}

        def checked(rows: DataFrame, family: Column, bonus: Column, joined: bool = False) -> DataFrame:
            """Pairs with first_sim: first as their surnames, places and deaths allow at best, then as they are."""
            rows = rows.where(blocking.fits())
            if not joined:
                rows = rows.withColumns(best).where(enough(self._by_sims(family, bonus))).drop("last_sim", "maiden_sim").join(lasts, ["s_last_no", "d_last_no"])
            rows = rows.withColumns({"birth_sim": compare.event("birth"), "place_sim": compare.places(), "death_sim": compare.event("death")}).where(enough(self._by_sims(family, bonus)))
            return rows.select("s_id", "d_id", "s_gender", "d_gender", "s_kin_no", "d_kin_no", *[f"{c}_sim" for c in compare.FIELDS])

        named = lambda df, p: df.where(" AND ".join(f"{p}_{c} IS NOT NULL" for c in PARENTS))
        by_parents = named(s, "s").join(_sent(firsts), "s_first_no")
        for c in PARENTS:
            by_parents = by_parents.join(_sent(self.parents.select(F.col("s_name").alias(f"s_{c}"), F.col("d_name").alias(f"d_{c}"))), f"s_{c}")
        by_parents = by_parents.join(named(d, "d").hint("merge"), ["d_first_no", *[f"d_{c}" for c in PARENTS]])
        bonus = F.when(has("parents", "parents"), F.when(has("child", "child"), 20.0).otherwise(10.0)).otherwise(0.0)
        out = checked(by_parents, F.lit(1.0), bonus)

        met = _side(self.ids[0], "s").join(_side(self.ids[1], "d").hint("merge"), (F.col("s_kind") == F.col("d_kind")) & (F.col("s_other") == F.col("d_other"))).where("NOT (s_known AND d_known)")
        met = met.select("s_id", "d_id").distinct().join(s.hint("merge"), "s_id").join(d.hint("merge"), "d_id").join(_sent(firsts), ["s_first_no", "d_first_no"])
        out = out.unionByName(checked(met, F.lit(1.0), F.lit(0.0)))

        close = lambda names: enough(self._by_names(names, self.part, 0.0))
        alike = s.join(_sent(firsts.where(close(("first",)))), "s_first_no").join(_sent(self.lasts.where(close(("last", "maiden")))), "s_last_no").where(close(("first", "last", "maiden")))
        out = out.unionByName(checked(alike.join(d.hint("merge"), [f"d_{c}" for c in no]), self._part(), F.lit(0.0), True))
        return self.scratch.keep(out.dropDuplicates(["s_id", "d_id"]), "sims")

    def scored(self, least: float, only: DataFrame | None = None) -> DataFrame:
        """compare.scored() of the pairs that score least or more; only: the ids of left that are asked for. Relatives are compared once for each distinct pair of families."""
        rows = self._pairs(least, only)
        text = lambda p: self.codes["kin_key"].select(F.col("code").alias(f"{p}_kin_no"), F.col("kin_key").alias(f"{p}_text")).hint("merge")
        families = rows.select("s_kin_no", "d_kin_no").distinct().join(text("s"), "s_kin_no").join(text("d"), "d_kin_no").select("s_kin_no", "d_kin_no", compare.families_of(F.col("s_text"), F.col("d_text")).alias("fam"))
        rows = rows.join(self.scratch.keep(families, "families").hint("merge"), ["s_kin_no", "d_kin_no"])
        return compare.scored(rows, self.weights).where(F.col("score") >= least)
