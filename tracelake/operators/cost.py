"""Cost from usage and effective-dated, tiered price rules, in decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONEY = "decimal(26,12)"
RULE = "provider string, model string, category string, from_ns long, to_ns long, tier_min long, tier_max long, unit_quantity long, unit_price decimal(18,9), discount decimal(9,6), currency string, organization_id string"
#: Widths of the bins that windows of validity are cut into, as powers of two of
#: nanoseconds (73 minutes, 39 hours, 52 days, 4.6 years, all): 32 of one make
#: one of the next.
BINS, STEP, FOREVER = (42, 47, 52, 57, 62), 5, (1 << 62) - 1
#: Fixed value: what may stand behind a model's name.
SUFFIX = r"[-@](?:\d{4}-\d{2}-\d{2}|\d{6,8}|v\d+|latest)$"
#: Categories in the order of a formula; others follow by name.
ORDER = ("input", "output", "cached_input", "cache_write", "reasoning")
#: What a cost record says of each component.
COMPONENTS = "array<struct<category:string,quantity:bigint,unit_quantity:bigint,unit_price:decimal(18,9),discount:decimal(9,6),amount:decimal(26,12),currency:string,tier_min:bigint>>"
#: A price book this small is sent to every task; a larger one is shuffled.
BROADCAST_RULES = 100_000


def normalise_model(model: Column) -> Column:
    """Without a trailing date, version number or ``latest``."""
    return F.regexp_replace(model, SUFFIX, "")


def tenant_rules(rules: DataFrame, organization: str) -> DataFrame:
    """The tenant's rules, and public ones that none of them shadows."""
    own = rules.filter(F.col("organization_id") == organization)
    key = ["provider", "model", "category", "tier_min", "from_ns"]
    return own.unionByName(rules.filter(F.col("organization_id").isNull()).join(own.select(*key), key, "left_anti"))


def overlaps(rules: DataFrame) -> DataFrame:
    """Rules whose window begins before the one before it ends."""
    w = W.partitionBy("organization_id", "provider", "model", "category", "tier_min").orderBy("from_ns", F.col("to_ns").asc_nulls_last())
    end = F.lag(F.coalesce("to_ns", F.lit((1 << 63) - 1))).over(w)
    return rules.withColumn("previous_to", end).filter(F.col("from_ns") < F.col("previous_to")).drop("previous_to")


def invalid(rules: DataFrame) -> DataFrame:
    return rules.filter("unit_price < 0 or unit_quantity <= 0 or discount < 0 or discount >= 1 or (to_ns is not null and to_ns <= from_ns) or (tier_max is not null and tier_max <= tier_min)")


def _price() -> Column:
    return (F.col("unit_price") * (F.lit(1).cast("decimal(9,6)") - F.coalesce("discount", F.lit(0).cast("decimal(9,6)")))).cast("decimal(24,12)")


def in_bins(rules: DataFrame) -> DataFrame:
    """``rules`` with ``_level, _bin``, a row for each bin that a rule's window
    takes: wide ones within, narrow ones at its ends, so there are at most some
    60 on a level; no two rules in force at different times share many."""
    a, b = F.shiftright("from_ns", BINS[0]), F.shiftright(F.coalesce(F.col("to_ns") - 1, F.lit(FOREVER)), BINS[0])
    out = rules.filter("to_ns is null or to_ns > from_ns").withColumn("_a", a).withColumn("_b", b)
    parts = []
    none = F.expr("cast(array() as array<bigint>)")
    run = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(none)
    for level in range(len(BINS)):
        first, last = F.col("_a"), F.col("_b")
        up, upto = F.shiftright(first + (1 << STEP) - 1, STEP), F.shiftright(last + 1, STEP) - 1
        wider = (up <= upto) if level < len(BINS) - 1 else F.lit(False)
        bins = F.when(first > last, none).when(wider, F.concat(run(first, up * (1 << STEP) - 1), run((upto + 1) * (1 << STEP), last))).otherwise(run(first, last))
        out = out.withColumn(f"_l{level}", bins)
        out = out.withColumn("_na", F.when(wider, up).otherwise(1)).withColumn("_nb", F.when(wider, upto).otherwise(0)).drop("_a", "_b").withColumnsRenamed({"_na": "_a", "_nb": "_b"})
        parts.append(F.transform(f"_l{level}", _at_level(level)))
    return out.select(*rules.columns, F.inline(F.concat(*parts)))


def _at_level(level: int):
    return lambda x: F.struct(F.lit(level).alias("_level"), x.cast("long").alias("_bin"))


def components(usage: DataFrame, rules: DataFrame, graduated: bool = False) -> DataFrame:
    """``id, category, quantity, tier_min, amount, currency, unit_quantity,
    unit_price, discount`` for ``usage`` rows ``id, provider, model, category,
    quantity, at_ns``.

    The rules of the most specific model that has one in force win: the exact
    name, then the name without its version, then ``*``.  By volume the whole
    quantity is charged at the tier that holds it (above all tiers, at the
    last); graduated, each tier's part at its own price.

    A use meets the rules of its model whose windows share a bin of time with
    it, not the model's whole history of prices.
    """
    # keys apart from usage's: the book's columns
    book = rules.select(F.lower("provider").alias("_p"), F.lower("model").alias("_m"), F.col("category").alias("_c"), "from_ns", "to_ns", "tier_min", "tier_max", "unit_quantity", "unit_price", "discount", "currency")
    book = in_bins(book)
    levels = sorted(r[0] for r in book.select("_level").distinct().collect())  # five at most
    use = usage.filter("quantity > 0").withColumn("_names", F.array_distinct(F.array(F.lower("model"), normalise_model(F.lower("model")), F.lit("*"))))
    at = F.array(*(F.struct(F.lit(k).alias("_l"), F.shiftright("at_ns", BINS[k]).alias("_t")) for k in levels)) if levels else F.expr("cast(array() as array<struct<_l:int,_t:bigint>>)")
    use = use.select("*", F.posexplode("_names").alias("_rank", "_name")).drop("_names").select("*", F.inline(at))
    if book.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        book = F.broadcast(book)
    same = (F.lower(F.col("provider")) == F.col("_p")) & (F.col("_name") == F.col("_m")) & (F.col("category") == F.col("_c")) & (F.col("_l") == F.col("_level")) & (F.col("_t") == F.col("_bin"))
    on = same & (F.col("at_ns") >= F.col("from_ns")) & (F.col("to_ns").isNull() | (F.col("at_ns") < F.col("to_ns")))
    hit = use.join(book, on).drop("_l", "_t", "_level", "_bin")
    group = W.partitionBy("id", "category")
    hit = hit.withColumn("_best", F.min("_rank").over(group)).filter("_rank = _best")
    hit = hit.withColumn("_tiers", F.count("*").over(group)).withColumn("_last", F.max("tier_min").over(group))
    holds = (F.col("quantity") >= F.col("tier_min")) & (F.col("tier_max").isNull() | (F.col("quantity") < F.col("tier_max")))
    if graduated:
        top = F.least("quantity", F.coalesce("tier_max", F.col("quantity")))
        part = F.when(F.col("_tiers") == 1, F.col("quantity")).otherwise(top - F.col("tier_min"))
        hit = hit.withColumn("_part", part).filter("_part > 0")
    else:
        any_holds = F.max(holds.cast("int")).over(group)
        hit = hit.withColumn("_held", any_holds).withColumn("_part", F.col("quantity")).filter(holds | ((F.col("_held") == 0) & (F.col("tier_min") == F.col("_last"))))
        hit = hit.withColumn("_one", F.row_number().over(group.orderBy("tier_min"))).filter("_one = 1")
    amount = F.bround((F.col("_part").cast("decimal(12,0)") * _price()) / F.col("unit_quantity").cast("decimal(12,0)"), 12).cast(MONEY)
    return hit.select("id", "category", F.col("_part").alias("quantity"), "tier_min", amount.alias("amount"), "currency", "unit_quantity", "unit_price", "discount")


def _plain(price: Column, least: int = 0) -> Column:
    """A decimal as text without zeros at its end, but for the first ``least``."""
    text = F.regexp_replace(price.cast("decimal(28,9)").cast("string"), r"0+$", "")
    whole, part = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    return F.concat(whole, F.when(F.greatest(F.length(part), F.lit(least)) > 0, ".").otherwise(""), F.when(F.length(part) < least, F.rpad(part, least, "0")).otherwise(part))


def _summed(usage: DataFrame, parts: DataFrame) -> DataFrame:
    by = parts.groupBy("id", "category").agg(F.sum("amount").alias("amount"))
    all_ = usage.filter("quantity > 0").select("id", "category", *(["usage_source"] if "usage_source" in usage.columns else [F.lit("provider").alias("usage_source")]))
    got = all_.join(by, ["id", "category"], "left").groupBy("id").agg(
        F.sum("amount").cast(MONEY).alias("total"),
        F.sum(F.col("amount").isNull().cast("long")).alias("unpriced"),
        F.bool_or(F.col("usage_source").isin("estimated", "missing")).alias("_soft"),
        F.sort_array(F.collect_set(F.when(F.col("amount").isNull(), F.col("category")))).alias("unpriced_categories"),
    )
    return got.select("id", "total", _status().alias("status"), "unpriced", "unpriced_categories")


def _status() -> Column:
    return F.when(F.col("total").isNull(), "unpriced").when((F.col("unpriced") > 0) | F.col("_soft"), "estimated").otherwise("final")


def costs(usage: DataFrame, rules: DataFrame, graduated: bool = False) -> DataFrame:
    """``id, total, status, unpriced``: final, estimated where a category has
    no price or usage was estimated, unpriced (total null) where none has."""
    return _summed(usage, components(usage, rules, graduated)).drop("unpriced_categories")


def breakdown(usage: DataFrame, rules: DataFrame, graduated: bool = False) -> DataFrame:
    """``costs`` with its audit: ``formula``, a sum that can be checked by hand,
    ``components``, what each category and tier was charged, in the order of
    ``ORDER``, ``currency`` and ``unpriced_categories``.  A use without a price
    has the formula 0."""
    made = components(usage, rules, graduated)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), F.col("category")), F.lit(0).cast("long")), F.lit(len(ORDER) + 1))
    base = F.concat(F.col("quantity").cast("string"), F.lit("/"), F.col("unit_quantity"), F.lit("*"), _plain(F.col("unit_price"), 2))
    formula = F.when(F.col("discount").isNull(), base).otherwise(F.concat(F.lit("("), base, F.lit(")*(1-"), _plain(F.col("discount")), F.lit(")")))
    item = F.struct(rank.alias("rank"), "category", "tier_min", "quantity", "unit_quantity", "unit_price", "discount", "amount", "currency", formula.alias("formula"))
    items = F.col("_items")
    kept = F.transform(items, lambda x: F.struct(*(x[c].alias(c) for c in ("category", "quantity", "unit_quantity", "unit_price", "discount", "amount", "currency", "tier_min"))))
    # one aggregate over what was used and what that was charged
    source = F.col("usage_source") if "usage_source" in usage.columns else F.lit("provider")
    used = usage.filter("quantity > 0").select("id", F.col("category").alias("_used"), source.isin("estimated", "missing").alias("_soft"))
    both = used.unionByName(made.select("id", item.alias("_item")), allowMissingColumns=True)
    got = both.groupBy("id").agg(
        F.collect_set("_used").alias("_used"), F.bool_or("_soft").alias("_soft"), F.sort_array(F.collect_list("_item")).alias("_items"), F.sum("_item.amount").cast(MONEY).alias("total"),
        F.collect_set(F.when(F.col("_item.amount").isNotNull(), F.col("_item.category"))).alias("_charged"),
    )
    got = got.withColumn("unpriced_categories", F.sort_array(F.array_except("_used", "_charged"))).withColumn("unpriced", F.size("unpriced_categories").cast("long"))
    some = F.size(items) > 0
    return got.select(
        "id", "total", _status().alias("status"), "unpriced", F.when(some, F.array_join(F.transform(items, lambda x: x["formula"]), " + ")).otherwise("0").alias("formula"),
        F.when(some, kept).alias("components"), F.when(some, F.coalesce(items[0]["currency"], F.lit(""))).otherwise("").alias("currency"), "unpriced_categories",
    )
