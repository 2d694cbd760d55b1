"""The same product across stores' feeds: by identifier, by model and specifications, by likeness."""

import difflib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cotejo.functions import text
from cotejo.operators.ordering import sorted_join
from cotejo.sources.written import durable

THRESHOLD = 0.60
_COMPARED = ("ram_gb", "storage_gb", "screen_in")
#: What decides whether two offers of a brand and model word go together.
_SIGN = ("source", *_COMPARED)
#: Rows (or pairs) of a brand that one task walks through; larger brands go in rounds of joins.
WALK = 20_000
#: Items of a brand on either side of a comparison.
BLOCK = 2_000
#: Comparisons of two blocks that one task makes, one after the other, where there are many.
MEETINGS = 16
#: Scores have four places, so a bound is safe within half of the last.
_PLACE = 0.0001


def prepare(offers: DataFrame) -> DataFrame:
    """Adds what the steps compare. (source, source_id) has to be unique."""
    spec = text.specs(F.col("name"))
    rows = offers.select(
        "pos", "source", "source_id", "name", text.normal_text(F.col("name")).alias("normal"), text.normal_text(F.coalesce("brand", F.lit(""))).alias("brand_key"), text.normal_identifier(F.col("identifier")).alias("identifier_key"),
        text.model_tokens(F.col("name")).alias("model"), spec.alias("spec"),
    )
    # Offers without identifier come first; the others by the first of their identifier. Those without one have a key each: they never come together in a task.
    leads = rows.where("identifier_key is not null").groupBy(F.col("identifier_key").alias("met")).agg(F.min("pos").alias("lead"))
    rows = sorted_join(rows.withColumn("met", F.coalesce("identifier_key", F.concat(F.lit("-"), F.col("pos").cast("string")))), leads, "met", "left")
    ord_ = F.when(F.col("identifier_key").isNull(), F.struct(F.lit(0).alias("a"), F.col("pos").alias("b"), F.lit(0).cast("long").alias("c"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("lead").alias("b"), F.col("pos").alias("c")))
    return rows.withColumn("ord", ord_).select("*", *(F.col(f"spec.{c}").alias(c) for c in _COMPARED)).drop("spec", "met", "lead")


def compatible(a: str, b: str) -> Column:
    """Brands and specifications of two rows, as aliases a and b, do not contradict."""
    one, two = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    fine = (one("brand_key") == "") | (two("brand_key") == "") | (one("brand_key") == two("brand_key"))
    for c in _COMPARED:
        fine &= F.coalesce(one(c) == two(c), F.lit(True))
    return fine


def by_identifier(rows: DataFrame) -> DataFrame:
    """Groups of one identifier: of at least two offers and sources, the first offer and each that fits all taken before it.

    Offers that fit each other add up to one brand and one value of each specification at most, so what is taken so far is one signature. An offer that
    doesn't fit it never will, and one that does makes room for all later offers of its own signature: only the distinct signatures of an identifier
    are walked through, in order of their first offers, however many offers have them.
    """
    signature = ("brand_key", *_COMPARED)
    coded = rows.where("identifier_key is not null")
    per = coded.groupBy("identifier_key", *signature).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    entry = F.struct("first", "n", F.struct(F.nullif("brand_key", F.lit("")).alias("brand_key"), *_COMPARED).alias("s"))
    codes = per.groupBy("identifier_key").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    agree = lambda x, y: F.coalesce(x == y, F.lit(True))

    def take(acc: Column, x: Column) -> Column:
        fits = agree(acc["s"][signature[0]], x["s"][signature[0]])
        for c in _COMPARED:
            fits &= agree(acc["s"][c], x["s"][c])
        both = F.struct(*(F.coalesce(acc["s"][c], x["s"][c]).alias(c) for c in signature))
        return F.when(fits, F.struct(both.alias("s"), F.concat(acc["kept"], F.array(x["first"])).alias("kept"), (acc["n"] + x["n"]).alias("n"))).otherwise(acc)

    one = F.get("e", F.lit(0))
    walked = F.aggregate(F.slice("e", 2, F.size("e")), F.struct(one["s"].alias("s"), F.array(one["first"]).alias("kept"), one["n"].alias("n")), take)
    kept = codes.select("identifier_key", walked.alias("w")).where("w.n > 1").select("identifier_key", F.explode("w.kept").alias("first"))
    signatures = sorted_join(per, kept, ["identifier_key", "first"]).select("identifier_key", *(F.col(c).alias(f"of_{c}") for c in signature))
    same = F.col("identifier_key") == F.col("code")
    for c in signature:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    found = coded.join(signatures.withColumnRenamed("identifier_key", "code").hint("merge"), same)
    return found.select(F.concat(F.lit("i:"), "identifier_key").alias("group_key"), "pos", F.lit("identifier").alias("matched_by"), F.lit(1.0).alias("confidence"))


def _least_of_signs(rows: DataFrame, name: str) -> DataFrame:
    """For each brand and model word, the earliest row of every sign: one entry for each sign, however many rows have it."""
    sign = F.struct(*_SIGN)
    per = rows.select("brand_key", sign.alias("sign"), "ord", "pos", F.explode("model").alias("token")).groupBy("brand_key", "token", "sign").agg(F.min(F.struct("ord", "pos")).alias("least"))
    return per.groupBy("brand_key", "token").agg(F.collect_list(F.struct("sign", "least")).alias(name))


def _earliest_fit(rows: DataFrame, blocks: DataFrame, name: str) -> DataFrame:
    """rows with `name`: the earliest entry (ord, pos) of blocks before the row that shares a brand and model word, comes from another source and contradicts in nothing; null if none."""

    def before(entry: Column) -> Column:
        sign, fine = entry["sign"], (entry["least"]["ord"] < F.col("ord")) & (entry["sign"]["source"] != F.col("source"))
        for c in _COMPARED:
            fine &= F.coalesce(sign[c] == F.col(c), F.lit(True))
        return fine

    met = rows.select("pos", "ord", "brand_key", *_SIGN, F.explode("model").alias("token"))
    met = sorted_join(met, blocks, ["brand_key", "token"])
    found = met.select("pos", F.array_min(F.transform(F.filter("entries", before), lambda e: e["least"])).alias("e")).groupBy("pos").agg(F.min("e").alias(name))
    return sorted_join(rows, found, "pos", "left")


def _by_size(rows: DataFrame, most: int, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of brands with at most `most`, rows of larger ones), as counted in rows or in sized, of which they are a part. There are at most rows / most of those, named in the plan."""
    large = [r[0] for r in (rows if sized is None else sized).groupBy("brand_key").count().where(F.col("count") > most).select("brand_key").collect()]
    return (rows.where(~F.col("brand_key").isin(large)), rows.where(F.col("brand_key").isin(large))) if large else (rows, None)


def _key() -> Column:
    """ord as a text of the same order."""
    return F.format_string("%d:%020d:%020d", F.col("ord.a"), F.col("ord.b"), F.col("ord.c"))


def _fits(s: tuple, t: tuple) -> bool:
    """Signs of different sources without a contradiction."""
    return s[0] != t[0] and all(x is None or y is None or x == y for x, y in zip(s[1:], t[1:]))


def _signs(block: pd.DataFrame) -> list[tuple]:
    return [tuple(None if pd.isna(v) else v for v in r) for r in zip(*(block[c] for c in _SIGN))]


def _walk_stars(block: pd.DataFrame) -> pd.DataFrame:
    """Stars of one brand, in one walk: a row joins the earliest centre of another source with a common model word that it doesn't contradict, or is one."""
    block = block.sort_values("key")
    centres: dict[str, dict[tuple, int]] = {}
    pos, stars = block["pos"].tolist(), []
    for i, (sign, model) in enumerate(zip(_signs(block), block["model"])):
        best = min((at for word in model for other, at in centres.get(word, {}).items() if _fits(sign, other)), default=None)
        if best is None:
            for word in model:
                centres.setdefault(word, {}).setdefault(sign, i)
        else:
            stars.append((pos[best], pos[i]))
    return pd.DataFrame(stars, columns=["anchor", "pos"])


def by_model(rows: DataFrame, rounds: int = 1000, sized: DataFrame | None = None) -> DataFrame:
    """Stars round the first free offer of a brand: other sources, a shared model word, nothing that contradicts.

    In order, an offer is the centre of a star unless an earlier centre goes with it; the others join their earliest centre.
    Brands of up to WALK offers are walked through by a task each. In a larger one each round settles at once all offers without an earlier unsettled one
    that goes with them; offers meet their word's earliest offer of every sign (source and specifications), never each
    other, so a frequent word costs its rows times its signs, not its pairs. Every round is written.
    """
    small, large = _by_size(rows.where(F.size("model") > 0), WALK, sized)
    stars = small.select("brand_key", "pos", _key().alias("key"), "model", *_SIGN).groupBy("brand_key").applyInPandas(_walk_stars, "anchor long, pos long")
    stars = stars if large is None else stars.unionByName(_stars_in_rounds(large, rounds))
    both = stars.unionByName(stars.select("anchor", F.col("anchor").alias("pos")).distinct())
    return both.select(F.concat(F.lit("m:"), F.col("anchor").cast("string")).alias("group_key"), "pos", F.lit("model_specs").alias("matched_by"), F.lit(0.9).alias("confidence"))


def _stars_in_rounds(rows: DataFrame, rounds: int) -> DataFrame:
    model = durable(rows.select("pos", "ord", "brand_key", "model", *_SIGN), "models")
    open_, centres = model, None
    for _ in range(rounds):
        seen = durable(_earliest_fit(open_, _least_of_signs(open_, "entries"), "earlier"), "round")
        new = seen.where("earlier is null").drop("earlier")
        centres = new if centres is None else centres.unionByName(new)
        open_ = durable(_earliest_fit(seen.where("earlier is not null").drop("earlier"), _least_of_signs(new, "entries"), "taken").where("taken is null").drop("taken"), "open")
        if open_.isEmpty():
            break
    else:
        raise RuntimeError(f"stars not settled after {rounds} rounds")
    others = sorted_join(model, centres.select("pos"), "pos", "left_anti")
    joined = _earliest_fit(others, _least_of_signs(centres, "entries"), "centre").where("centre is not null")
    return durable(joined.select(F.col("centre.pos").alias("anchor"), "pos"), "stars")


def equal_names(rows: DataFrame) -> DataFrame:
    """(a_pos, b_pos, score): pairs of equal names of a brand, which score 1 and so come before all others: each offer in order takes the next free one of another source that contradicts in nothing.

    Only names that several sources have are looked at. They lie sorted in their partitions and stream by; what is held of a name are its free offers by sign.
    """
    by = ["brand_key", "normal"]
    shared = rows.groupBy(*by).agg(F.min("source").alias("lo"), F.max("source").alias("hi")).where("lo <> hi").select(*by)
    names = sorted_join(rows.select(*by, "pos", *_SIGN, _key().alias("key")), shared, by)

    def walk(batches):
        name, waiting, seen = None, {}, 0
        for block in batches:
            out = []
            for now, pos, sign in zip(zip(block["brand_key"], block["normal"]), block["pos"].tolist(), _signs(block)):
                if now != name:
                    name, waiting = now, {}
                # The earliest free offer that goes with this one takes it, which is what taking the next free one in order comes to.
                best = min((queue[0] for other, queue in waiting.items() if queue and _fits(other, sign)), default=None)
                seen += 1
                if best is None:
                    waiting.setdefault(sign, deque()).append((seen, pos, sign))
                else:
                    waiting[best[2]].popleft()
                    out.append((best[1], pos, 1.0))
            yield pd.DataFrame(out, columns=["a_pos", "b_pos", "score"])

    return names.repartition(*by).sortWithinPartitions(*by, "key").mapInPandas(walk, "a_pos long, b_pos long, score double")


class Names:
    """Distinct names with what bounds their likeness: words, and how often each letter stands in them (letters beyond the common ones count as one, which only loosens the bound)."""

    _LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}

    def __init__(self, names: list[str], words: list[list[str]]):
        self.names, self.number = names, {n: i for i, n in enumerate(names)}
        self.letters = np.zeros((len(names), len(self._LETTERS) + 1), np.int16)
        for i, n in enumerate(names):
            np.add.at(self.letters[i], [self._LETTERS.get(c, len(self._LETTERS)) for c in n], 1)
        self.size, self.words = np.array([len(n) for n in names]), words
        self.counts = np.array([len(w) for w in words])
        self.having: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for x in w:
                self.having.setdefault(x, []).append(i)

    def likeness(self, name: str, words: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of common words with each name, upper bound of the likeness of characters)."""
        met = [i for w in words for i in self.having.get(w, ())]
        common = np.bincount(met, minlength=len(self.names)) if met else np.zeros(len(self.names), np.int64)
        union = len(words) + self.counts - common
        shared = np.where((self.counts > 0) & bool(words), common / np.maximum(union, 1), 0.0)
        total = self.size + len(name)
        return shared, np.where(total > 0, 2 * np.minimum(self.letters, letters).sum(axis=1) / np.maximum(total, 1), 1.0)


def compare_blocks(left: pd.DataFrame, right: pd.DataFrame | None, threshold: float) -> tuple[list, list, int]:
    """Items (pos and key of the first row, upto: key of the last one (missing: of one row), source, normal, words, free, specifications) of a brand -> (pairs (pos, other pos, score
    where the first's row comes first, score where the other's does) of free items of which one score reaches the threshold; each free item's candidates of the other block as
    (pos, [(other pos, other key, both scores), ...]); how many pairs of names had their characters compared). right None: the items of left among each other.

    Names are compared once, however many items have them. An upper bound, of words and letters, stands before every comparison: pairs are compared if it
    reaches the threshold, candidates in order of their bounds until none left can win.
    """
    blocks = [_columns(b) for b in ([left] if right is None else [left, right])]
    ratios: dict[tuple[str, str], float] = {}

    def score(a: str, b: str, shared: float, factor: float) -> float:
        if (a, b) not in ratios:
            ratios[a, b] = difflib.SequenceMatcher(None, a, b).ratio()
        return round((0.5 * shared + 0.5 * ratios[a, b]) * factor, 4)

    pairs, best = [], []
    for mine, (names, items, sign) in enumerate(blocks):
        other_names, others, other_sign = blocks[-1 - mine]
        source, specs = np.array([s[0] for s in other_sign], object), [np.array([np.nan if s[k] is None else s[k] for s in other_sign], float) for k in range(1, len(_SIGN))]
        free = np.array([o[4] for o in others], bool)
        of_name = np.array([other_names.number[o[0]] for o in others])
        cache: dict[str, tuple] = {}
        for p, ((name, pos, key, upto, mine_free), own) in enumerate(zip(items, sign)):
            if not mine_free:
                continue
            if name not in cache:
                at = names.number[name]
                cache[name] = other_names.likeness(name, names.words[at], names.letters[at])
            shared, most = cache[name]
            conflict = np.zeros(len(others), bool)
            for k, v in enumerate(own[1:]):
                if v is not None:
                    conflict |= ~np.isnan(specs[k]) & (specs[k] != v)
            factor = np.where(conflict, 0.3, 1.0)
            bound = (0.5 * shared + 0.5 * most)[of_name] * factor + _PLACE
            bound[source == own[0]] = -1.0

            def ahead(q: int) -> float:
                """The score where this name comes first."""
                return score(name, others[q][0], shared[of_name[q]], factor[q])

            def behind(q: int) -> float:
                return score(others[q][0], name, shared[of_name[q]], factor[q])

            # Every pair of items once: of one block the later item leaves it to the earlier.
            for q in np.flatnonzero((bound >= threshold) & free) if mine == 0 else ():
                if (right is not None or q > p) and max(ahead(q), behind(q)) >= threshold:
                    pairs.append((pos, others[q][1], ahead(q), behind(q)))
            tried, sure = [], 0.0
            for q in np.argsort(-bound, kind="stable"):
                if bound[q] < max(sure, _PLACE):
                    break
                _, other, other_key, other_upto, _ = others[q]
                # Where one item ends before the other begins, only one of the two scores is met.
                one = ahead(q) if upto < other_key or other_upto > key else behind(q)
                two = behind(q) if other_upto < key or other_key < upto else one
                tried.append((other_key, other, one, two))
                sure = max(sure, min(one, two))
            best.append((pos, _needed(tried, sure)))
    return pairs, [(pos, found) for pos, found in best if found], len(ratios)


def _needed(tried: list[tuple], sure: float) -> list[tuple]:
    """Of (key, pos, ahead, behind), as (pos, key, ahead, behind), those that can be the best for some row. Where ahead is not above behind a row's candidate is the other item's first row, so of equal scores the earliest will do."""
    found: dict = {}
    for key, pos, ahead, behind in sorted(tried):
        if max(ahead, behind, 0.0) >= max(sure, _PLACE / 2):
            found.setdefault((ahead, behind) if ahead <= behind else pos, (pos, key, ahead, behind))
    return list(found.values())


def _columns(block: pd.DataFrame) -> tuple[Names, list[tuple], list[tuple]]:
    """(names, items (name, pos, key, upto, free), their signs)."""
    words = {name: list(w) for name, w in zip(block["normal"], block["words"])}
    upto = block["upto" if "upto" in block else "key"]
    return Names(list(words), list(words.values())), list(zip(block["normal"], block["pos"].tolist(), block["key"], upto, block["free"])), _signs(block)


def as_items(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows as item, pos, key, free; items): rows of equal name and sign score alike, so they are one item, which has the number of its first row. Items: brand_key, normal, sign, pos and key of the first row, upto, whether a row is free."""
    by = ["brand_key", "normal", *_SIGN]
    keyed = rows.select(*by, "pos", _key().alias("key"), "free")
    per = keyed.groupBy(*by).agg(F.min(F.struct("key", "pos")).alias("first"), F.max("key").alias("upto"), F.bool_or("free").alias("free"))
    items = durable(per.select(*by, "first.pos", "first.key", "upto", "free"), "items")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    numbers = items.select(F.col("pos").alias("item"), *(F.col(c).alias(f"of_{c}") for c in by))
    return durable(keyed.join(numbers.hint("merge"), same).select("item", "pos", "key", "free"), "of-items"), items


_SCORED = "brand_key string, item long, other long, other_key string, ahead double, behind double, best boolean"


def scored(items: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Of as_items: pairs of free items of which one score reaches threshold (best false), and what can be the best candidate of a free item's row in each block it met (best true); ahead is the score where the item's row comes before the other's.

    The items of a brand are dealt out in blocks by hash, and every two blocks are compared by a task, so no task holds more than two blocks, however many rows they stand for.
    """
    cut = items.groupBy("brand_key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    one = F.pmod(F.xxhash64("pos"), F.col("blocks")).cast("int")
    dealt = sorted_join(items, cut, "brand_key").withColumn("mine", one).withColumn("words", text.content_tokens(F.col("normal")))
    dealt = dealt.select("brand_key", "pos", "key", "upto", "normal", "words", "free", *_SIGN, "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("met"))
    dealt = dealt.withColumns({"i": F.least("mine", "met"), "j": F.greatest("mine", "met")})
    # Few bytes, much work: a number of parts that Spark leaves as it is, and by the two blocks, lest a brand's be one task's.
    meetings = cut.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(meetings) // MEETINGS)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        left, right = (group, None) if i == j else (group[group["mine"] == i], group[group["mine"] == j])
        pairs, best, _ = compare_blocks(left, right, threshold) if len(left) and (right is None or len(right)) else ([], [], 0)
        brand = group["brand_key"].iloc[0]
        out = [(brand, pos, other, "", *scores, False) for pos, other, *scores in pairs] + [(brand, pos, *candidate, True) for pos, found in best for candidate in found]
        return pd.DataFrame(out, columns=["brand_key", "item", "other", "other_key", "ahead", "behind", "best"])

    return dealt.repartition(parts, "brand_key", "i", "j").groupBy("brand_key", "i", "j").applyInPandas(run, _SCORED)


def _row_pairs(found: DataFrame, rows: DataFrame, threshold: float) -> DataFrame:
    """(brand_key, a_pos, b_pos, a_key, b_key, score) of the free rows of scored pairs of items that score threshold or more, the earlier row first."""
    free = rows.where("free")
    one = free.select("item", F.struct("key", "pos").alias("x"))
    two = free.select(F.col("item").alias("other"), F.struct("key", "pos").alias("y"))
    met = sorted_join(sorted_join(found.where("not best").drop("best", "other_key"), one, "item"), two, "other")
    met = met.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y"), "score": F.when(F.col("x") < F.col("y"), F.col("ahead")).otherwise(F.col("behind"))})
    return met.where(F.col("score") >= threshold).select("brand_key", F.col("a.pos").alias("a_pos"), F.col("b.pos").alias("b_pos"), F.col("a.key").alias("a_key"), F.col("b.key").alias("b_key"), "score")


def _best_candidates(found: DataFrame, rows: DataFrame, asked: DataFrame) -> DataFrame:
    """(pos, candidate, score) of asked rows (item, pos, key): the best by score, then order, that scored names for their items."""
    most = found.where("best").groupBy("item").agg(F.max(F.least("ahead", "behind")).alias("sure"))
    kept = sorted_join(found.where("best"), most, "item").where(F.greatest("ahead", "behind") >= F.col("sure")).select("item", "other", "other_key", "ahead", "behind")
    met = durable(sorted_join(asked.select("item", "pos", "key"), kept, "item").drop("item"), "candidates")
    before = F.col("other_key") < F.col("key")
    first = met.select("pos", F.struct((-F.when(before, F.col("behind")).otherwise(F.col("ahead"))).alias("down"), F.col("other_key").alias("key"), F.col("other").alias("pos")).alias("c"))
    # Only where the later rows of an item score more than its first does the next one after the row count.
    later = met.where(before & (F.col("ahead") > F.col("behind")))
    wanted = later.select("other").distinct()
    lines = later.select("other", "key", F.struct("pos", "ahead").alias("asks"), F.lit(None).cast("struct<key:string,pos:bigint>").alias("at"))
    own = sorted_join(rows.select(F.col("item").alias("other"), "key", F.lit(None).cast("struct<pos:bigint,ahead:double>").alias("asks"), F.struct("key", "pos").alias("at")), wanted, "other", "left_semi")
    upwards = Window.partitionBy("other").orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = lines.unionByName(own).withColumn("next", F.last("at", ignorenulls=True).over(upwards)).where("asks is not null and next is not null")
    next_ = after.select("asks.pos", F.struct((-F.col("asks.ahead")).alias("down"), F.col("next.key").alias("key"), F.col("next.pos").alias("pos")).alias("c"))
    best = first.unionByName(next_).groupBy("pos").agg(F.min("c").alias("c")).where("c.down < 0")
    return best.select("pos", F.col("c.pos").alias("candidate"), (-F.col("c.down")).alias("score"))


def likeness(rows: DataFrame) -> DataFrame:
    """(a_pos, b_pos, score) of all pairs of a brand from different sources that score above 0, the earlier offer first: half the share of common words, half the likeness of characters, less if specifications contradict."""
    of_items, items = as_items(rows.withColumn("free", F.lit(True)))
    return _row_pairs(scored(items, _PLACE), of_items, _PLACE).select("a_pos", "b_pos", "score")


def greedy_pairs(scores: DataFrame) -> DataFrame:
    """(a_pos, b_pos, score) of (brand_key, a_pos, b_pos, a_key, b_key, score): pairs taken by score, then order, each offer once.

    Brands of up to WALK pairs are walked through by a task each. In a larger one, round after round takes the pairs that are best for both
    sides, which gives the same pairs; the best pair of all is taken in each round, so rounds end. Every round is written.
    """

    def walk(block: pd.DataFrame) -> pd.DataFrame:
        block = block.assign(down=-block["score"]).sort_values(["down", "a_key", "b_key"])
        used, out = set(), []
        for a, b, s in zip(block["a_pos"], block["b_pos"], block["score"]):
            if a not in used and b not in used:
                used |= {a, b}
                out.append((a, b, s))
        return pd.DataFrame(out, columns=["a_pos", "b_pos", "score"])

    small, left = _by_size(scores, WALK)
    found = small.groupBy("brand_key").applyInPandas(walk, "a_pos long, b_pos long, score double")
    while left is not None and not left.isEmpty():
        ends = left.select(F.col("a_pos").alias("pos"), "score", "a_key", "b_key", "a_pos", "b_pos").unionByName(left.select(F.col("b_pos").alias("pos"), "score", "a_key", "b_key", "a_pos", "b_pos"))
        best = ends.groupBy("pos").agg(F.min_by(F.struct("a_pos", "b_pos"), F.struct(-F.col("score"), F.col("a_key"), F.col("b_key"))).alias("p"))
        both = best.groupBy("p.a_pos", "p.b_pos").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
        mutual = durable(sorted_join(left, both, ["a_pos", "b_pos"]).select("a_pos", "b_pos", "score"), "mutual")
        found = found.unionByName(mutual)
        taken = mutual.select(F.explode(F.array("a_pos", "b_pos")).alias("pos"))
        left = sorted_join(left, taken.withColumnRenamed("pos", "a_pos"), "a_pos", "left_anti")
        left = durable(sorted_join(left, taken.withColumnRenamed("pos", "b_pos"), "b_pos", "left_anti"), "scores")
    return found


def likeness_steps(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs (a_pos, b_pos, score) taken greedily by score, then order; best (pos, candidate, score) of each offer that is in no pair).

    Pairs of equal names come first, all in one step; of what is left, items (rows of equal name and sign) are compared in blocks, once for both results.
    """
    first = durable(equal_names(rows).where(F.col("score") >= threshold), "equal-names")
    met = first.select(F.explode(F.array("a_pos", "b_pos")).alias("pos"), F.lit(False).alias("free"))
    of_items, items = as_items(sorted_join(rows, met, "pos", "left").withColumn("free", F.coalesce("free", F.lit(True))))
    out = durable(scored(items, threshold), "scored")
    pairs = durable(_row_pairs(out, of_items, threshold), "pairs")
    found = durable(first.unionByName(greedy_pairs(pairs)), "by-likeness")
    paired = found.select(F.explode(F.array("a_pos", "b_pos")).alias("pos"))
    return found, _best_candidates(out, of_items, sorted_join(of_items, paired, "pos", "left_anti"))


def _similar_groups(found: DataFrame) -> DataFrame:
    return found.select(F.concat(F.lit("s:"), F.col("a_pos").cast("string")).alias("group_key"), F.explode(F.array("a_pos", "b_pos")).alias("pos"), F.lit("similarity").alias("matched_by"), F.col("score").alias("confidence"))


def by_likeness(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of at least `threshold` as groups, taken greedily by score, then order."""
    return _similar_groups(likeness_steps(rows, threshold)[0])


def match_offers(offers: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(groups in long form, review): every step works on what the one before left.

    review has the offers in no group: status pending with best candidate, score and question, or singleton where no pair scored above 0.
    """
    rows = durable(prepare(offers), "offers")
    first = durable(by_identifier(rows), "by-identifier")
    second = by_model(sorted_join(rows, first.select("pos"), "pos", "left_anti"), sized=rows)
    certain = durable(first.unionByName(second), "certain")
    rest = durable(sorted_join(rows, certain.select("pos"), "pos", "left_anti"), "rest")
    found, best = likeness_steps(rest, threshold)
    third = _similar_groups(found)
    left = sorted_join(sorted_join(rest, third.select("pos"), "pos", "left_anti"), best, "pos", "left")
    other = rows.select(F.col("pos").alias("candidate"), F.col("source").alias("other_source"), F.col("name").alias("other_name"))
    review = sorted_join(left, other, "candidate", "left")
    question = F.when(F.col("candidate").isNotNull(), text.same_product_prompt(F.col("source"), F.col("name"), F.col("other_source"), F.col("other_name")))
    status = F.when(F.col("candidate").isNull(), "singleton").otherwise("pending")
    return certain.unionByName(third), review.select("pos", status.alias("status"), "candidate", F.coalesce("score", F.lit(0.0)).alias("score"), question.alias("question"))


def report(offers: DataFrame, groups: DataFrame, review: DataFrame, n_groups: int = 10, n_pending: int = 5) -> DataFrame:
    """(section, place, text) of a run's report: its first groups over sources, in order of their first offers, and its first pending questions."""
    per = sorted_join(groups, offers.select("pos", "source"), "pos").groupBy("group_key").agg(F.min("pos").alias("first"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    keys = [r[0] for r in per.where("lo <> hi").orderBy("first").limit(n_groups).select("group_key").collect()]
    # The names are looked up of these few groups' offers only.
    named = sorted_join(groups.where(F.col("group_key").isin(keys)), offers.select("pos", "source", "name"), "pos")
    said = F.struct("pos", F.concat("source", F.lit(": "), "name").alias("t"))
    listed = named.groupBy("group_key", "matched_by", "confidence").agg(F.min("pos").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"]), " | ").alias("offers"))
    shown = listed.select(F.lit("group").alias("section"), "first", F.format_string("[%s, %.2f] %s", "matched_by", "confidence", "offers").alias("text"))
    asked = review.where("status = 'pending'").orderBy("pos").limit(n_pending).select(F.lit("pending").alias("section"), F.col("pos").alias("first"), F.col("question").alias("text"))
    return shown.unionByName(asked).withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy("first"))).select("section", "place", "text")


def match_stats(offers: DataFrame, groups: DataFrame, review: DataFrame) -> DataFrame:
    counted = groups.groupBy("group_key", "matched_by").count().groupBy().agg(
        F.count(F.lit(1)).alias("groups"), *(F.count_if(F.col("matched_by") == m).alias(f"by_{m}") for m in ("identifier", "model_specs", "similarity"))
    )
    left = review.agg(F.count_if(F.col("status") == "pending").alias("pending_review"), F.count_if(F.col("status") == "singleton").alias("singletons"))
    return offers.agg(F.count(F.lit(1)).alias("input_offers")).join(counted).join(left)
