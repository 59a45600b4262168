"""The registered queries: each operator of the inventory over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.functions.identifiers import normalise_symbol
from panelwright.functions.schema import (
    MARKET_FIELDS, STATUS_FIELDS, SchemaError, encoded_positions, feature_names, select_features,
)
from panelwright.operators import assets, boosting, cross_section as xs, cube, labels, losses, panel as panels, profiles, quality, ranker
from panelwright.operators import ranks, screening, splits, statistics, views
from panelwright.operators.staging import scratch_dir, stage, tune
from panelwright.plans.fixtures import (
    PanelTables, event_factors, event_tables, supplier_bars, supplier_tables, table, wide_tables,
)
from panelwright.sources import feeds, tables as files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

SPLIT_DATES = {
    "train_start": "1995-01-01", "train_end": "1999-01-01",
    "valid_start": "1999-01-01", "valid_end": "2000-07-01",
    "test_start": "2000-07-01", "test_end": "2002-01-01",
}
LOOKBACK = 5  # the events span 30 days
SAMPLE_K = 512
N_CLASSES = 5


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def rounded(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[r6(c).alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in df.columns])


def opened(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select("date", "sid", r6(f"{label}.value").alias("label"), F.col(f"{label}.valid").alias("label_valid"),
                     F.col(f"{label}.reason").alias("label_reason"))


# --- sources and normalisation -------------------------------------------------------------


@query
def symbol_normalize(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    digits = F.lpad(key.cast("string"), 6, "0")
    first = F.element_at(F.array(*[F.lit(d) for d in "69480"]), (F.floor(key / 6) % 5 + 1).cast("int"))
    raw = (
        F.when(key % 6 == 0, F.concat(digits, F.lit(".XSHE")))
        .when(key % 6 == 1, F.concat(digits, F.lit(".xshg ")))
        .when(key % 6 == 2, F.concat(F.lit(" sh"), digits))
        .when(key % 6 == 3, F.concat(F.lit("SZ"), digits))
        .when(key % 6 == 4, F.concat(digits, F.lit(".v1.XBEJ")))
        .otherwise(F.concat(first, F.lpad((key % 100000).cast("string"), 5, "0")))
    )
    return table(spark, sf, "customer").select("c_custkey", raw.alias("raw")).select(
        "c_custkey", "raw", normalise_symbol(F.col("raw")).alias("sid")
    )


def _raw_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a raw feed: several rows per key, text dates, some of them bad, some ids missing."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(spark, sf, "lineitem").select(
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "bad").otherwise(day).alias("trade_date"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 6), None)
        .otherwise(F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("order_book_id"),
        F.col("l_extendedprice").alias("open"),
        (F.col("l_extendedprice") * 2).alias("high"),
        (F.col("l_extendedprice") / 2).alias("low"),
        (F.col("l_extendedprice") - F.col("l_quantity")).alias("close"),
        F.col("l_quantity").alias("volume"),
        F.col("l_tax").alias("money"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


@query
def bars_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(feeds.normalise_bars(_raw_bars(spark, sf), order=["l_orderkey", "l_linenumber", "l_partkey"]))


def _write_years(spark: SparkSession, sf: str, path: str, layouts: list[list[Column]]) -> None:
    """Order lines as a yearly feed whose layout changes from year to year; lines of a day and supplier stay in order."""
    lines = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    first, last = lines.agg(F.year(F.min("day")), F.year(F.max("day"))).first()
    for year in range(first, last + 1):
        own = lines.where(F.year("day") == year).repartition("day", "l_suppkey")
        own = own.sortWithinPartitions("day", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
        own.select(*layouts[year % len(layouts)]).write.parquet(f"{path}/year={year}.parquet")


@query
def yearly_bars_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly bars with other names, types and date forms each year, read as one feed."""
    code = F.lpad(F.col("l_suppkey").cast("string"), 6, "0")
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    prices = [price.alias("open"), (price * 2).alias("high"), (price / 2).alias("low"), (price - quantity).alias("close")]
    path = scratch_dir(spark, "bars")
    _write_years(spark, sf, path, [
        [F.date_format("day", "yyyyMMdd").alias("trade_date"), F.concat(code, F.lit(".XSHE")).alias("order_book_id"), *prices, quantity.cast("long").alias("volume")],
        [F.col("day").alias("date"), F.concat(F.lit("SZ"), code).alias("symbol"), *prices, quantity.alias("volume"), F.col("l_tax").alias("money")],
        [F.date_format("day", "yyyy/MM/dd").alias("datetime"), F.concat(code, F.lit(".sz")).alias("ts_code"), *prices, quantity.alias("volume")],
    ])
    return rounded(feeds.read_bars(spark, path))


@query
def yearly_factors_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly factors of which some exist in some years only, and one column that is left out."""
    code, quantity = F.lpad(F.col("l_suppkey").cast("string"), 6, "0"), F.col("l_quantity").alias("quantity")
    path = scratch_dir(spark, "factors")
    _write_years(spark, sf, path, [
        [F.date_format("day", "yyyy-MM-dd").alias("datetime"), F.concat(code, F.lit(".XSHE")).alias("order_book_id"), quantity.cast("float"), F.col("l_discount").alias("discount")],
        [F.col("day").alias("date"), F.concat(F.lit("SZ"), code).alias("instrument"), quantity, F.col("l_tax").alias("tax"), F.col("l_tax").alias("scratch")],
        [F.date_format("day", "yyyyMMdd").alias("trade_date"), F.concat(code, F.lit(".SZ")).alias("ts_code"), quantity, F.col("l_discount").alias("discount")],
    ])
    return rounded(feeds.read_factors(spark, path, exclude=["scratch"]))


@query
def yearly_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of three years of a yearly feed, one of which some years lack, with duplicates in."""
    path = scratch_dir(spark, "factors")
    quantity, tax = F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax")
    _write_years(spark, sf, path, [[F.col("day").alias("date"), quantity, tax], [F.col("day").alias("date"), quantity.cast("float"), F.col("l_discount").alias("discount")]])
    rows = files.read_yearly(spark, path, 1994, 1996, ["quantity", "tax"])
    return rounded(rows.groupBy(F.regexp_extract("_file", r"year=(\d+)", 1).cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"), F.sum("tax").alias("tax")))


@query
def source_drop_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.drop_counts(_raw_bars(spark, sf))


@query
def bars_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return quality.source_counts(feeds.bar_keys(feeds.normalise_bars(_raw_bars(spark, sf), order=["l_orderkey", "l_linenumber", "l_partkey"])))


@query
def factor_normalize(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(
        F.to_date("ts").alias("datetime"),
        F.concat(F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(".XSHG")).alias("order_book_id"),
        F.concat(F.lit("SH"), F.col("user_id").cast("string")).alias("instrument"),
        "value",
        F.length("props").cast("double").alias("fund__props"),
        (F.col("value") * 2).alias("scratch"),
        "event_id",
    )
    factors = feeds.factor_values(feeds.normalise_factors(ev, order=["event_id"], exclude=["scratch"]))
    return factors.select("date", "sid", *[r6(f"feature.{n}").alias(f"feature_{n}") for n in feature_names(factors)])


@query
def date_range_scan(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    kept = ev.where((F.col("ts") >= F.lit("2024-01-08").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")))
    return kept.select("date", "event_id", "user_id", r6("value").alias("value"))


@query
def dup_key_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# --- assets --------------------------------------------------------------------------------


@query
def instrument_master_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_tables(spark, sf).master


@query
def instrument_master_parts(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_partkey").cast("string").alias("sid"))
    return assets.instrument_master(keys)


@query
def trading_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return assets.trading_calendar(supplier_bars(spark, sf), "1996-01-01", "2000-12-31")


@query
def trading_day_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Orders on the ship-date calendar; dates outside it have no index."""
    orders = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("sid"))
    return labels.with_trading_day(orders, assets.trading_calendar(supplier_bars(spark, sf), "1996-01-01")).select("date", "sid", "td_idx")


@query
def status_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return assets.status_intervals(event_tables(spark, sf).daily)


@query
def active_session_index(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    return panels.active_session_index(t.master, t.calendar).select("date", "sid", "td_idx")


# --- panel ---------------------------------------------------------------------------------


@query
def panel_base_status(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(event_tables(spark, sf).panel.select("date", "sid", *[f"status.{f}" for f in STATUS_FIELDS]))


@query
def panel_status_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Status of rows with two hundred factors."""
    fields = ("factor_state", "factor_missing_ratio", "feature_all_missing", "sample_state", "sample_usable_for_feature")
    return rounded(wide_tables(spark, sf).panel.select("date", "sid", *[f"status.{f}" for f in fields]))


@query
def panel_base_values(spark: SparkSession, sf: str) -> DataFrame:
    p = event_tables(spark, sf).panel
    return rounded(p.select(
        "date", "sid",
        *[F.col(f"market.{f}").alias(f"market_{f}") for f in MARKET_FIELDS],
        *[F.col(f"feature.{f}").alias(f"feature_{f}") for f in feature_names(p)],
        F.col("meta.symbol").alias("meta_symbol"), F.col("meta.list_date").alias("meta_list_date"),
    ))


@query
def sample_state_hist(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.state_histogram(event_tables(spark, sf).panel))


@query
def sample_state_hist_suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.state_histogram(supplier_tables(spark, sf).series))


@query
def bool_status_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.boolean_rates(event_tables(spark, sf).panel))


@query
def missing_ratio_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(quality.missing_ratio_profile(event_tables(spark, sf).panel))


@query
def state_sets(spark: SparkSession, sf: str) -> DataFrame:
    return quality.state_sets(event_tables(spark, sf).panel)


@query
def panel_sanity_findings(spark: SparkSession, sf: str) -> DataFrame:
    return quality.sanity_findings(supplier_tables(spark, sf).series).select("severity", "check", "message")


@query
def panel_date_slice(spark: SparkSession, sf: str) -> DataFrame:
    p = event_tables(spark, sf).panel.where((F.col("date") >= "2024-01-10") & (F.col("date") < "2024-01-20"))
    return rounded(p.select("date", "sid", F.col("market.close").alias("close"), F.col("status.sample_state").alias("sample_state")))


@query
def panel_day_slice(spark: SparkSession, sf: str) -> DataFrame:
    return splits.day_slice(event_tables(spark, sf).panel, 5, 12).select("date", "sid", "td_idx")


@query
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.read_feature_rows(event_tables(spark, sf).panel)
    return rounded(rows.select("date", "sid", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(("f1", "f2", "f3"))]))


@query
def panel_schema(spark: SparkSession, sf: str) -> DataFrame:
    return files.table_profile(event_tables(spark, sf).panel.select("date", "sid", "market", "feature"))


@query
def panel_axis_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Dense day and instrument codes of every panel row."""
    p = event_tables(spark, sf).panel.select("date", "sid", F.col("td_idx").alias("t"))
    codes = ranks.dense_codes(p, "sid", "n")
    return p.join(codes, "sid").select("date", "sid", "t", F.col("n").cast("int").alias("n"))


# --- targets -------------------------------------------------------------------------------


def _event_target(spark: SparkSession, sf: str, name: str) -> DataFrame:
    t = event_tables(spark, sf)
    return labels.build_target(t.panel, t.calendar, name)


def _supplier_target(spark: SparkSession, sf: str, name: str) -> DataFrame:
    t = supplier_tables(spark, sf)
    return labels.series_targets(t.records, t.master, t.calendar, [labels.make_recipe(name)]).select("date", "sid", F.col(name).alias("label"))


def _register_target(name: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return opened(_event_target(spark, sf, name))

    run.__name__ = name
    query(run)


for _target in labels.list_targets():
    _register_target(_target)


@query
def targets_together(spark: SparkSession, sf: str) -> DataFrame:
    """Every built-in target from one window, reduced to reason counts per target."""
    t = supplier_tables(spark, sf)
    names = labels.list_targets()
    blocks = labels.series_targets(t.records, t.master, t.calendar, [labels.make_recipe(n) for n in names])
    items = [F.struct(F.lit(n).alias("target"), F.col(n)["reason"].alias("reason")) for n in names]
    long = blocks.select(F.inline(F.array(*items)))
    return long.groupBy("target", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def return_forward_filled(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    recipe = labels.ForwardFilledReturnRecipe("filled", "c0c3")
    return opened(labels.build_targets(t.panel, t.calendar, [recipe]), "filled")


class DayRangeRecipe(labels.Recipe):
    """The day's own range, high over low less one: a label of the user's making."""

    name = "day_range"

    def required_columns(self) -> list[str]:
        return ["market.high", "market.low"]

    def offsets(self) -> list[tuple[str, int]]:
        return [(c, 0) for c in self.required_columns()]

    def reason(self, at: labels.PriceAt, position: labels.CalendarPosition) -> Column:
        usable = [F.coalesce(at(c, 0) > 0, F.lit(False)) for c in self.required_columns()]
        return F.when(~position.known(), "not_in_calendar").when(~(usable[0] & usable[1]), "missing_price").otherwise("")

    def value(self, at: labels.PriceAt) -> Column:
        return F.try_divide(at("market.high", 0), at("market.low", 0)) - 1


@query
def custom_target(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    return opened(labels.build_targets(t.panel, t.calendar, [DayRangeRecipe()]), "day_range")


@query
def configured_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Targets as a configuration names them, one with its own formula."""
    t = event_tables(spark, sf)
    wanted = labels.requested_targets({"targets": [{"name": "return_5d", "params": {"formula": "c0c3"}}, {"name": "return_c1c2"}]})
    blocks = labels.build_targets(t.panel, t.calendar, [labels.make_recipe(n, **params) for n, params in wanted])
    items = [F.struct(F.lit(n).alias("target"), r6(f"{n}.value").alias("label"), F.col(f"{n}.valid").alias("label_valid"), F.col(f"{n}.reason").alias("label_reason"))
             for n, _ in wanted]
    return blocks.select("date", "sid", F.inline(F.array(*items)))


@query
def label_guards(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    flat = t.panel.select("date", "sid", "td_idx", "market", "meta.list_date", "meta.delist_date")
    blocks = labels.build_targets(flat, t.calendar, [labels.make_recipe("return_5d")], keep=["td_idx", "list_date", "delist_date"])
    return opened(labels.label_guards(blocks, t.calendar, "return_5d", horizon=5, min_listed_days=7))


@query
def joint_train_mask(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    both = labels.build_targets(t.panel, t.calendar, [labels.make_recipe("return_c0c1"), labels.make_recipe("momentum_cls")], keep=["status"])
    usable, suspended = F.col("status.sample_usable_for_feature"), F.col("status.is_suspended")
    return both.select(
        "date", "sid",
        labels.train_mask(usable, [F.col("return_c0c1")]).alias("single_mask"),
        labels.train_mask(usable, [F.col("return_c0c1")], suspended).alias("trading_mask"),
        labels.train_mask(usable, [F.col("return_c0c1"), F.col("momentum_cls")]).alias("joint_mask"),
    )


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The panel and its targets, each stored in buckets of the key: they are joined where they lie."""
    t, names, keys = event_tables(spark, sf), ("return_c0c1", "momentum_cls"), ["date", "sid"]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    panel = spark.read.table(files.bucketed(t.panel, keys, buckets))
    blocks = spark.read.table(files.bucketed(labels.build_targets(panel, t.calendar, [labels.make_recipe(n) for n in names]), keys, buckets))
    return panel, labels.label_panel(panel, {n: blocks.select("date", "sid", F.col(n).alias("label")) for n in names})


@query
def panel_labeled(spark: SparkSession, sf: str) -> DataFrame:
    _, labelled = _labelled(spark, sf)
    quality.validate_labels_exist(labelled, ["return_c0c1", "momentum_cls"])
    return rounded(labelled.select(
        "date", "sid", F.col("market.close").alias("close"), F.col("status.sample_state").alias("sample_state"),
        F.col("return_c0c1.value").alias("y_return"), F.col("return_c0c1.reason").alias("return_reason"),
        F.col("momentum_cls.value").alias("y_momentum"), F.col("momentum_cls.reason").alias("momentum_reason"),
    ))


@query
def panel_labeled_check(spark: SparkSession, sf: str) -> DataFrame:
    return quality.labelled_panel_violations(*_labelled(spark, sf))


@query
def target_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    target = _supplier_target(spark, sf, "return_o1c5")
    quality.validate_target(target)
    return quality.target_violations(target)


@query
def target_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.target_summary(_supplier_target(spark, sf, "return_o1c2")))


@query
def target_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.target_reasons(_supplier_target(spark, sf, "return_o1c2")))


@query
def target_profile_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.regression_profile(_supplier_target(spark, sf, "return_5d")))


@query
def target_profile_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.class_distribution(_event_target(spark, sf, "momentum_cls"), labels.MOMENTUM_CLASSES))


@query
def target_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.regression_by_year(_supplier_target(spark, sf, "return_20d")))


@query
def target_classes_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.classes_by_year(_supplier_target(spark, sf, "momentum_cls"), sorted(labels.MOMENTUM_CLASSES)))


@query
def target_findings_regression(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.target_findings(_supplier_target(spark, sf, "return_5d"), "regression"))


@query
def target_findings_class(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(profiles.target_findings(_event_target(spark, sf, "momentum_cls"), "classification"))


# --- splits, selection, views --------------------------------------------------------------


@query
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    calendar = assets.trading_calendar(supplier_bars(spark, sf))
    return splits.split_ranges(calendar, SPLIT_DATES, lookback=60)


@query
def time_split_days(spark: SparkSession, sf: str) -> DataFrame:
    calendar = assets.trading_calendar(supplier_bars(spark, sf))
    return splits.split_days(calendar, splits.split_ranges(calendar, SPLIT_DATES, lookback=60)).select("date", "td_idx", "split")


def _with_labels(t: PanelTables, *names: str) -> DataFrame:
    """What views need of the panel, with labels beside it: derived once, joined to nothing."""
    return labels.series_targets(t.records, t.master, t.calendar, [labels.make_recipe(n) for n in names], keep=["td_idx", "feature", "status"])


def _supplier_view(spark: SparkSession, sf: str, label: str = "return_c0c1") -> tuple[PanelTables, DataFrame]:
    """Supplier rows with a record. Who reads them takes usable rows only, and rows without a record are not."""
    t = supplier_tables(spark, sf)
    labelled = labels.build_targets(t.recorded, t.calendar, [labels.make_recipe(label)], keep=["td_idx", "feature", "status"])
    view = views.tabular_view(labelled, label, exclude="(?i)scratch", fundamentals=["fund__top_price"])
    return t, splits.with_split(view, t.calendar, splits.split_ranges(t.calendar, SPLIT_DATES))


@query
def feature_screen(spark: SparkSession, sf: str) -> DataFrame:
    t, view = _supplier_view(spark, sf)
    names = select_features(feature_names(t.panel), exclude="(?i)scratch", fundamentals=["fund__top_price"])
    return rounded(screening.feature_profile(view.where("split = 'train'"), names, missing_drop_thresh=0.3, exclude="(?i)quantity").withColumn("variance", F.round("variance", 2)))


@query
def tabular_view(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    view = views.tabular_view(_with_labels(t, "return_c1c2"), "return_c1c2", include="f[12]$")
    return rounded(view.select("date", "sid", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(("f1", "f2"))], "y", "y_valid", "usable"))


@query
def tabular_view_without_target(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    view = views.tabular_view(t.panel, None, exclude="f1$")
    return rounded(view.select("date", "sid", F.get("features", F.lit(0)).alias("f2"), F.get("features", F.lit(1)).alias("f3"), "y", "y_valid", "usable"))


@query
def aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features in the number and order that a model was fitted with."""
    p = event_tables(spark, sf).panel
    view = screening.align_features(views.tabular_view(p, None), feature_names(p), ["f3", "f1"])
    return rounded(view.select("date", "sid", F.get("features", F.lit(0)).alias("first"), F.get("features", F.lit(1)).alias("second")))


@query
def view_metadata(spark: SparkSession, sf: str) -> DataFrame:
    p = event_tables(spark, sf).panel
    return views.view_metadata(p, feature_names(p), "return_c1c2")


def _event_encoded(spark: SparkSession, sf: str) -> tuple[PanelTables, DataFrame, int]:
    t = event_tables(spark, sf)
    return t, views.encoded_view(_with_labels(t, "return_c0c1", "momentum_cls"), "return_c0c1", "momentum_cls"), 2 * len(feature_names(t.panel)) + 1


def _cells(df: DataFrame, width: int, x: str = "x") -> list[Column]:
    return [F.get(x, F.lit(i)).alias(f"x{i}") for i in range(width)]


MASKS = ("ret_mask", "mom_mask", "both_mask")


@query
def isna_encoding(spark: SparkSession, sf: str) -> DataFrame:
    _, view, width = _event_encoded(spark, sf)
    return rounded(view.select("date", "sid", *_cells(view, width), "present", "y_ret", F.col("y_mom").cast("int").alias("y_mom"), *MASKS))


@query
def encoded_feature_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Train-time subset of the encoded layout: f1 dropped, its flag with it, the present flag kept."""
    t, view, _ = _event_encoded(spark, sf)
    names = feature_names(t.panel)
    width = len(encoded_positions(names, exclude="f1$"))
    kept = view.withColumn("x", views.keep_encoded(F.col("x"), names, exclude="f1$"))
    return rounded(kept.select("date", "sid", *_cells(kept, width)))


@query
def dense_cube_cells(spark: SparkSession, sf: str) -> DataFrame:
    t, view, width = _event_encoded(spark, sf)
    cells = views.dense_cells(view, t.calendar, width)
    return rounded(cells.select("date", "sid", "td_idx", *_cells(cells, width), "present", "y_ret", F.col("y_mom").cast("int").alias("y_mom"), *MASKS))


def _event_cube(spark: SparkSession, sf: str) -> cube.Cube:
    t, view, width = _event_encoded(spark, sf)
    return cube.write_cube(stage(view), t.calendar, scratch_dir(spark, "cube"), width)


@query
def cube_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell that exists, read back from the tiles of a stored cube."""
    held = _event_cube(spark, sf)
    return rounded(cube.read_cells(held).select("date", "sid", "td_idx", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(held.width)], "present", "y_ret", F.col("y_mom").cast("int").alias("y_mom"), *MASKS))


@query
def cube_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Days 5 to 12 of a stored cube for the instruments without a delisting date, absent cells included."""
    held = _event_cube(spark, sf)
    listed = event_tables(spark, sf).master.where("delist_date is null")
    cells = cube.read_cells(held, 5, 12, listed, absent=True)
    return rounded(cells.select("date", "sid", "td_idx", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(held.width)], "present", "y_ret", F.col("y_mom").cast("int").alias("y_mom"), *MASKS))


@query
def cube_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that exist on each day and for each instrument, counted on the maps of a stored cube."""
    held = _event_cube(spark, sf)
    days = cube.coverage_by_day(held).select(F.lit("day").alias("axis"), F.col("date").cast("string").alias("key"), "n_cells")
    return days.unionByName(cube.coverage_by_instrument(held).select(F.lit("instrument").alias("axis"), F.col("sid").alias("key"), "n_cells"))


@query
def daily_sample_k(spark: SparkSession, sf: str) -> DataFrame:
    t, view, _ = _event_encoded(spark, sf)
    return xs.sample_per_day(stage(view.select("date", "sid", "present")), SAMPLE_K, "present", instruments=t.master).select("date", "sid", "present", F.col("sample_pos").cast("int").alias("sample_pos"))


def _window_stats(width: int, lookback: int) -> list[Column]:
    """What a SQL engine can recompute of a window."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))

    flags = F.transform("window", lambda x: F.get(x, F.lit(width - 1)))
    return [F.size("window").alias("steps"), total(flags).alias("present_steps"), total(F.get("window", F.lit(0))).alias("oldest_sum"),
            total(F.get("window", F.lit(lookback - 1))).alias("newest_sum")]


@query
def lookback_window_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of sampled rows, reduced to what a SQL engine can recompute: step count, sum and first value per window."""
    t, view, width = _event_encoded(spark, sf)
    view = stage(view)
    sampled = xs.sample_per_day(view.select("date", "sid", "present"), SAMPLE_K, "present", instruments=t.master)
    sampled = sampled.join(xs.per_day(t.calendar.select("date", "td_idx")), "date")
    windows = views.lookback_windows(view, sampled, LOOKBACK, width)
    return rounded(windows.select("date", "sid", *_window_stats(width, LOOKBACK), "y_ret", F.col("y_mom").cast("int").alias("y_mom"), *MASKS))


@query
def lookback_supplier_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of 60 days over the suppliers' years, reduced as above."""
    t = supplier_tables(spark, sf)
    view, width = stage(views.encoded_view(_with_labels(t, "return_c0c1", "momentum_cls"), "return_c0c1", "momentum_cls")), 2 * len(feature_names(t.panel)) + 1
    # The sample is read for its blocks and for its windows.
    sampled = stage(xs.sample_per_day(view.select("date", "sid", "td_idx", "present"), SAMPLE_K, "present").select("date", "sid", "td_idx"))
    windows = views.lookback_windows(view, sampled, 60, width, few=True)
    return rounded(windows.select("date", "sid", *_window_stats(width, 60), "y_ret", F.col("y_mom").cast("int").alias("y_mom"), *MASKS))


@query
def view_report(spark: SparkSession, sf: str) -> DataFrame:
    t, view, width = _event_encoded(spark, sf)
    return rounded(profiles.view_report(view, t.calendar, (width - 1) // 2))


@query
def view_by_year(spark: SparkSession, sf: str) -> DataFrame:
    t = supplier_tables(spark, sf)
    view = views.encoded_view(_with_labels(t, "return_c0c1", "momentum_cls"), "return_c0c1", "momentum_cls")
    return rounded(profiles.view_by_year(view, t.calendar))


# --- cross-section -------------------------------------------------------------------------


def _event_labelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    t = event_tables(spark, sf)
    return views.tabular_view(_with_labels(t, "return_c0c1"), "return_c0c1").where("y_valid and usable")


@query
def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return xs.group_sizes(_event_labelled_rows(spark, sf))


@query
def small_group_filter(spark: SparkSession, sf: str) -> DataFrame:
    return xs.drop_small_groups(_event_labelled_rows(spark, sf), 55).select("date", "sid", r6("y").alias("y"))


@query
def relevance_bins_avg(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(_event_labelled_rows(spark, sf).select("date", "sid", "y"))
    return rounded(xs.relevance_bins(rows, "y", 10))


@query
def relevance_bins_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of bar volume: few distinct values, so ties dominate; missing volumes get 0."""
    p = stage(event_tables(spark, sf).panel.select("date", "sid", F.col("market.volume").alias("volume")))
    return rounded(xs.relevance_bins(p, "volume", 10))


@query
def relevance_bins_desc(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf).select("date", "sid", "y_ret", "ret_mask")
    return rounded(xs.relevance_levels(rows, "y_ret", "ret_mask", 5))


@query
def ranking_dataset(spark: SparkSession, sf: str) -> DataFrame:
    _, view = _supplier_view(spark, sf)
    # The rows go out without features, so features are not stored.
    rows = stage(view.where("y_valid and usable").select("date", "sid", "split", "y", "y_valid", "usable"))
    return rounded(xs.ranking_rows(rows, min_group_size=5, n_bins=10, clip_y_abs=0.5).select("date", "sid", "split", "y_raw", "relevance"))


@query
def xs_norm_rank(spark: SparkSession, sf: str) -> DataFrame:
    p = stage(event_tables(spark, sf).panel.select("date", "sid", F.col("feature.f1").alias("f1")))
    return rounded(xs.normalise(p, "f1", "rank", "f1_norm"))


@query
def xs_norm_zscore(spark: SparkSession, sf: str) -> DataFrame:
    p = event_tables(spark, sf).panel.select("date", "sid", F.col("feature.f1").alias("f1"))
    return rounded(xs.normalise(p, "f1", "zscore", "f1_norm"))


# --- rank metrics and losses ---------------------------------------------------------------


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation rows: labels and masks with a score and class logits computed from the day's own bar."""
    t = event_tables(spark, sf)
    blocks = labels.build_targets(
        t.panel, t.calendar, [labels.make_recipe("return_c0c1"), labels.make_recipe("momentum_cls")], keep=["market"]
    )
    move = (F.col("market.close") - F.col("market.open")) / (F.col("market.close") + F.col("market.open"))
    rows = blocks.select(
        "date", "sid",
        F.coalesce(F.col("return_c0c1.value"), F.lit(0.0)).cast("double").alias("y_ret"),
        F.col("return_c0c1.valid").alias("ret_mask"),
        F.when(F.col("momentum_cls.valid"), F.col("momentum_cls.value").cast("int")).otherwise(-1).alias("y_mom"),
        F.coalesce(move, F.lit(0.0)).alias("pred_ret"),
        F.when(F.col("date") < "2024-01-16", "first").otherwise("second").alias("split"),
    )
    p = F.col("pred_ret")
    return stage(rows.withColumn("logits", F.array(-p, p / 4, F.lit(0.25), p / 2, p)))


def _supplier_predictions(spark: SparkSession, sf: str) -> DataFrame:
    _, view = _supplier_view(spark, sf)
    # Features are sorted: discount, fund__top_price, quantity, tax.
    return stage(view.where("y_valid and usable").select(
        "date", "sid", "split", F.col("y").alias("y_raw"), F.get("features", F.lit(2)).alias("pred")
    ))


@query
def rankic_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.rank_ic_daily(_supplier_predictions(spark, sf)))


@query
def rankic_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.rank_ic_summary(xs.rank_ic_daily(_supplier_predictions(spark, sf), by=["split", "date"]), ["split"]))


@query
def ic_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(xs.ic_daily(_model_rows(spark, sf), "y_ret", "pred_ret", "ret_mask"))


@query
def cls_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(losses.class_accuracy_daily(_model_rows(spark, sf), "y_mom", "logits", N_CLASSES))


@query
def masked_mse(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(losses.masked_mse(_model_rows(spark, sf), "y_ret", "pred_ret", "ret_mask", ["date"]))


@query
def cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    term = losses.cross_entropy_term(F.col("logits"), losses.clean_class(F.col("y_mom"), N_CLASSES))
    return rounded(_model_rows(spark, sf).groupBy("date").agg(F.avg(term).alias("ce_loss"), F.count(term).alias("n_labelled")))


def _ranked_model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return xs.relevance_levels(_model_rows(spark, sf), "y_ret", "ret_mask", 5)


@query
def ndcg_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(losses.ndcg_at_k(_ranked_model_rows(spark, sf), "pred_ret", "relevance", 20))


@query
def lambdarank_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(losses.lambda_rank_daily(_ranked_model_rows(spark, sf), "pred_ret", "relevance", "ret_mask", k=20))


@query
def lambdarank_loss(spark: SparkSession, sf: str) -> DataFrame:
    daily = losses.lambda_rank_daily(_ranked_model_rows(spark, sf), "pred_ret", "relevance", "ret_mask", k=20)
    split = F.when(F.col("date") < "2024-01-16", "first").otherwise("second")
    return rounded(losses.lambda_rank_loss(daily.withColumn("split", split), ["split"]))


@query
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(losses.evaluate(_model_rows(spark, sf), "split", N_CLASSES))


@query
def eval_rollup_lambdarank(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(losses.evaluate(_model_rows(spark, sf), "split", N_CLASSES, use_lambda_rank=True, k=20, bins=5))


# --- ranker (rows-only) --------------------------------------------------------------------

# The operator's own parameters, but for the least size of a day: the fixture has about 20 suppliers a day.
RANKER = ranker.RankerParams(min_group_size=3)


def _ranker_run(spark: SparkSession, sf: str, refit: bool) -> ranker.RankerRun:
    t, view = _supplier_view(spark, sf)
    names = select_features(feature_names(t.panel), exclude="(?i)scratch", fundamentals=["fund__top_price"])
    return ranker.run(stage(view.where("y_valid and usable")), names, RANKER, refit_before_test=refit)


@query
def gbt_rank_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _ranker_run(spark, sf, refit=False).predictions


@query
def gbt_rank_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows a ranker predicts: per split the rows, days, instruments and labels, and that every prediction is a number."""
    finite = F.count_if(F.col("pred").isNotNull() & ~F.isnan("pred") & (F.abs("pred") < float("inf")))
    return _ranker_run(spark, sf, refit=False).predictions.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_days"), F.count_distinct("sid").alias("n_sids"),
        F.round(F.sum(F.col("y_raw").cast("double")), 3).alias("y_sum"), finite.alias("n_finite"))


@query
def gbt_rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _ranker_run(spark, sf, refit=True).metrics


# --- boosted ranker ------------------------------------------------------------------------

BOOST = boosting.BoostParams(rounds=3, patience=3, learning_rate=0.1, max_depth=4, min_instances=20, k=10)


@query
def rank_gradients_daily(spark: SparkSession, sf: str) -> DataFrame:
    """First and second derivatives of the ranking objective by each row's score."""
    rows = stage(_ranked_model_rows(spark, sf).where("ret_mask").select("date", "sid", "relevance", "pred_ret"))
    return rounded(boosting.rank_gradients(rows, "pred_ret", "relevance", boosting.BoostParams(k=20)).select("date", "sid", "grad", "hess"))


def _boosted(spark: SparkSession, sf: str) -> tuple[DataFrame, boosting.BoostState]:
    """Ranking rows of the three splits and a model boosted on train and judged on valid."""
    t, view = _supplier_view(spark, sf)
    names = select_features(feature_names(t.panel), exclude="(?i)scratch", fundamentals=["fund__top_price"])
    rows = stage(ranker.model_rows(stage(view.where("y_valid and usable")), RANKER))
    return rows, boosting.boost(spark, boosting.start(rows, names, int(spark.conf.get("spark.sql.shuffle.partitions"))), BOOST)


def _equal(a: str, b: str) -> Column:
    return F.count_if(F.abs(F.col(a) - F.col(b)) <= 1e-9 * (1 + F.abs(F.col(b))))


@query
def rank_boost_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """For every round, the rows and days that the metric judged, and how many margins equal the score of that many trees by themselves."""
    rows, state = _boosted(spark, sf)
    out = None
    for n in range(1, len(state.values) + 1):
        scored = boosting.scoring_pipeline(state.model.first(n)).transform(rows.where("split = 'valid'").select("date", "sid", "x"))
        both = boosting.margins(spark, state.after(n)).join(scored, ["date", "sid"]).where("split = 'valid'")
        found = both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_days"), _equal("margin", "pred").alias("n_equal")).select(F.lit(n).alias("round"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query
def rank_boost_store(spark: SparkSession, sf: str) -> DataFrame:
    """A model saved, loaded and applied to the view: per split the rows it scores, and how many scores equal those of training."""
    rows, state = _boosted(spark, sf)
    path = scratch_dir(spark, "model")
    boosting.save(spark, state.model, path)
    scored = boosting.load(spark, path).score(rows.select("split", "date", "sid", "features", "usable"), state.model.features)
    both = scored.join(boosting.margins(spark, state), state.keys)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("date").alias("n_days"), F.count_distinct("sid").alias("n_sids"),
                                     _equal("margin", "pred").alias("n_equal"))


# --- sources, sinks and contracts ------------------------------------------------------------


@query
def panel_store_range(spark: SparkSession, sf: str) -> DataFrame:
    """A panel written by year and read back for a range of days, three columns of it."""
    path = scratch_dir(spark, "panel")
    files.write_panel(event_tables(spark, sf).panel, path)
    df = files.read_date_range(spark, path, "2024-01-10", "2024-01-20", ["date", "sid", "td_idx", "market.close", "status.sample_state"])
    return rounded(df)


@query
def panel_year_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """A stored panel of which one year is written again, twice, with other volumes and drifted types."""
    path, t = scratch_dir(spark, "panel"), supplier_tables(spark, sf)
    rows = t.series.select("date", "sid", "td_idx", F.col("market.volume").alias("volume"), F.col("status.sample_state").alias("sample_state"))
    files.write_panel(rows, path)
    year = stage(spark.read.parquet(path).where("year = 1996").drop("year"))
    for times in (3, 2):
        files.replace_years(year.select("date", "sid", F.col("td_idx").cast("long").alias("td_idx"), (F.col("volume") * times).alias("volume"), "sample_state"), path)
    return rounded(spark.read.parquet(path).drop("year"))


@query
def sanity_from_years(spark: SparkSession, sf: str) -> DataFrame:
    """Findings on a stored panel from the states of its years, of which the last was added afterwards and one corrected."""
    path, states = scratch_dir(spark, "panel"), scratch_dir(spark, "states")
    t = supplier_tables(spark, sf)
    panels.write_series_panel(t.records, t.master, t.calendar, path)
    panel = spark.read.parquet(path)
    years = sorted(r["year"] for r in panel.select("year").distinct().collect())
    for some in (years[:-1], years[-1:], years[:1]):
        statistics.update_panel_states(panel, states, some)
    return statistics.merged_findings(spark.read.parquet(states))


@query
def histogram_from_years(spark: SparkSession, sf: str) -> DataFrame:
    """The sample states of the whole panel from those of its years."""
    states = scratch_dir(spark, "states")
    statistics.update_panel_states(supplier_tables(spark, sf).series, states)
    return rounded(statistics.merged_histogram(spark.read.parquet(states)))


@query
def target_profile_from_years(spark: SparkSession, sf: str) -> DataFrame:
    """Profile of a stored target from the states of its years, added in two steps."""
    path, states = scratch_dir(spark, "target"), scratch_dir(spark, "states")
    files.write_panel(_supplier_target(spark, sf, "return_5d"), path)
    target = spark.read.parquet(path)
    years = sorted(r["year"] for r in target.select("year").distinct().collect())
    for some in (years[:-1], years[-1:]):
        statistics.update_target_states(target, states, some)
    return rounded(statistics.merged_profile(spark, states))


@query
def feature_screen_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Variance and missing rate of two hundred factors, over all rows with a label."""
    t = wide_tables(spark, sf)
    # Labels are built without the features; those of usable rows meet them where they lie, in a hash join that neither moves nor sorts wide rows.
    narrow = labels.build_targets(t.recorded, t.calendar, [labels.make_recipe("return_c0c1")], keep=["td_idx", "status"])
    labelled = t.factors.join(narrow.where(f"return_c0c1.valid AND {views.USABLE}").hint("shuffle_hash"), ["date", "sid"])
    view = views.tabular_view(labelled, "return_c0c1")
    found = screening.feature_profile(view, feature_names(t.panel), missing_drop_thresh=0.02, exclude="w1[0-9]$")
    return rounded(found.withColumn("variance", F.round("variance", 2)))


@query
def calendar_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Ship dates as a CSV calendar with repeated days, read back for a range."""
    path = scratch_dir(spark, "calendar")
    days = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy/MM/dd").alias("trade_date"), "l_linenumber").distinct()
    days.write.option("header", True).csv(path)
    return files.read_calendar_csv(spark, path, "1995-01-01", "1998-12-31")


@query
def target_store(spark: SparkSession, sf: str) -> DataFrame:
    """A target table written and read back."""
    t = event_tables(spark, sf)
    path = scratch_dir(spark, "target")
    labels.build_target(t.panel, t.calendar, "return_c0c1").write.parquet(path)
    return opened(files.read_target(spark, path))


@query
def predictions_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions written as CSV with a header and read back."""
    path = scratch_dir(spark, "predictions")
    files.write_predictions(_model_rows(spark, sf).select("date", "sid", r6("y_ret").alias("y_raw"), r6("pred_ret").alias("pred")), path)
    return rounded(spark.read.csv(path, header=True, schema="date date, sid string, y_raw double, pred double"))


@query
def run_metrics_store(spark: SparkSession, sf: str) -> DataFrame:
    """Days of the rank IC per split, appended for two runs to one table."""
    path = scratch_dir(spark, "metrics")
    summary = stage(xs.rank_ic_summary(xs.rank_ic_daily(_supplier_predictions(spark, sf), by=["split", "date"]), ["split"]))
    rows = summary.select("split", F.lit("rank_ic_n_days").alias("metric"), F.col("rank_ic_n_days").cast("double").alias("value"))
    for run_id in ("first", "second"):
        files.append_run_metrics(rows, run_id, path)
    return spark.read.parquet(path)


@query
def contracts_hold(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table whose contract was checked; a broken contract raises."""
    t = event_tables(spark, sf)
    bars = feeds.normalise_bars(_raw_bars(spark, sf), order=["l_orderkey", "l_linenumber", "l_partkey"])
    checked = [
        ("raw bars", quality.validate_raw_bars, stage(bars)),
        ("raw factors", quality.validate_raw_factors, stage(event_factors(spark, sf))),
        ("daily bars", quality.validate_daily_bars, t.daily),
        ("factor values", quality.validate_factor_values, t.factors),
        ("instrument master", quality.validate_instrument_master, t.master),
        ("trading calendar", quality.validate_trading_calendar, t.calendar),
        ("panel", quality.validate_panel, stage(t.panel)),
    ]
    out = None
    for name, validate, df in checked:
        validate(df)
        rows = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def run_features_store(spark: SparkSession, sf: str) -> DataFrame:
    """Features that screening keeps, in order, appended for two runs to one table and read back with what they hold."""
    t, view = _supplier_view(spark, sf)
    names = select_features(feature_names(t.panel), exclude="(?i)scratch", fundamentals=["fund__top_price"])
    profile = stage(screening.feature_profile(view, names, exclude="(?i)quantity").withColumn("variance", F.round("variance", 2)))
    path = scratch_dir(spark, "features")
    for run_id in ("first", "second"):
        files.append_run_features(spark, screening.kept_features(profile), run_id, path)
    return spark.read.parquet(path).join(profile, "feature").select("run_id", "position", "feature", "n_rows", "variance")


@query
def contracts_broken(spark: SparkSession, sf: str) -> DataFrame:
    """Tables with a fault each: how many rows are at fault, and that the contract refuses the table."""
    t = event_tables(spark, sf)
    panel, idle = stage(t.panel), F.col("market.volume") <= 0
    daily, factors, master = stage(t.daily), stage(t.factors), stage(t.master)
    late = F.col("list_date") >= "2024-01-01"
    faults = [
        ("daily bars", "repeated keys", quality.validate_daily_bars, daily.unionByName(daily.where(idle)), daily.where(idle)),
        ("factor values", "repeated keys", quality.validate_factor_values, factors.unionByName(factors.where("feature.f2 is null")), factors.where("feature.f2 is null")),
        ("factor values", "no features", quality.validate_factor_values, factors.select("date", "sid"), factors),
        ("instrument master", "no list date", quality.validate_instrument_master, master.withColumn("list_date", F.when(~late, F.col("list_date"))), master.where(late)),
        ("trading calendar", "repeated days", quality.validate_trading_calendar, t.calendar.unionByName(t.calendar), t.calendar),
        ("panel", "a label inside", quality.validate_panel, panel.withColumn("label", F.col("td_idx")), panel),
        ("panel", "repeated keys", quality.validate_panel, panel.unionByName(panel.where("status.is_suspended")), panel.where("status.is_suspended")),
        ("labelled panel", "no such label", lambda df: quality.validate_labels_exist(df, ["return_c0c1"]), panel, panel),
    ]
    out = None
    for name, fault, validate, df, at_fault in faults:
        try:
            validate(df)
            refused = False
        except SchemaError:
            refused = True
        row = at_fault.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), F.lit(fault).alias("fault"), "n_rows", F.lit(refused).alias("refused"))
        out = row if out is None else out.unionByName(row)
    return out
