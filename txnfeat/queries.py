"""Named queries over the provided tables and their DuckDB SQL.

Values that two engines may round apart in the last place are rounded to six digits here, never in the operators."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters
from .operators import CARD, LEDGER, add_card_history, add_card_rowwise, add_history, add_ledger_history, add_ledger_rowwise, prune_near_constant
from .operators import metrics, profile, subset
from .operators.blocks import add_history_in_blocks
from .operators.distinct import add_prior_distinct
from .operators.encode import frequency_encode
from .operators.history import History
from .operators.ledger import split_column
from .operators.trainfit import add_amount_by_type
from .operators.validate import parity, quality_counts
from .plans.batch import card_features, ledger_features
from .specs import INDICATORS
from .streaming import dlq

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # + 0.0 makes a negative zero positive.
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LEDGER = f"with ledger as ({adapters.LEDGER_SQL}) "
_CARD = f"with card as ({adapters.CARD_SQL}) "
_FLAG = "cast(case when {} then 1 else 0 end as tinyint)"


def _flags(**predicates: str) -> str:
    return ", ".join(f"{_FLAG.format(p)} as {name}" for name, p in predicates.items())


@query(_LEDGER + "select event_id, cast(step % 24 as int) as step_hour, round(sin((step % 24) * (2 * pi() / 24)), 6) + 0.0::double as hour_sin, round(cos((step % 24) * (2 * pi() / 24)), 6) + 0.0::double as hour_cos, cast(floor((step - 1) / 24) as int) as sim_day, round(ln(1 + greatest(0.0, amount)), 6) as amount_log1p, round(amount / (oldbalanceOrg + 1.0), 6) as amt_to_oldbalOrg, round(amount / (oldbalanceDest + 1.0), 6) as amt_to_oldbalDest, case when step <= 500 then 'train' when step <= 600 then 'valid' else 'test' end as split, " + _flags(history_window_complete_flag="step >= 169", type_transfer="type = 'TRANSFER'", type_cash_out="type = 'CASH_OUT'", type_payment="type = 'PAYMENT'", type_cash_in="type = 'CASH_IN'", type_debit="type = 'DEBIT'", amount_zero_flag="amount = 0", orig_drain_flag="oldbalanceOrg > 0 and abs(amount - oldbalanceOrg) < 0.005", amount_exceeds_orig_balance_flag="amount > oldbalanceOrg", orig_balance_zero_flag="oldbalanceOrg = 0", dest_balance_zero_flag="oldbalanceDest = 0 and type <> 'PAYMENT'") + " from ledger")
def ledger_rowwise(spark, sf_dir):
    names = ["step_hour", "hour_sin", "hour_cos", "sim_day", "history_window_complete_flag", *(f"type_{t}" for t in ("transfer", "cash_out", "payment", "cash_in", "debit")), "split", "amount_log1p", "amount_zero_flag", "amt_to_oldbalOrg", "amt_to_oldbalDest", "orig_drain_flag", "amount_exceeds_orig_balance_flag", "orig_balance_zero_flag", "dest_balance_zero_flag"]
    out = add_ledger_rowwise(adapters.ledger(spark, sf_dir), include_tier_b=False).select("event_id", *names)
    return _rounded(out, "hour_sin", "hour_cos", "amount_log1p", "amt_to_oldbalOrg", "amt_to_oldbalDest")


@query(_LEDGER + "select event_id, newbalanceOrig + amount - oldbalanceOrg as err_balance_orig, oldbalanceDest + amount - newbalanceDest as err_balance_dest, " + _flags(orig_new_balance_zero_flag="newbalanceOrig = 0") + " from ledger")
def ledger_tier_b(spark, sf_dir):
    return add_ledger_rowwise(adapters.ledger(spark, sf_dir)).select("event_id", "err_balance_orig", "err_balance_dest", "orig_new_balance_zero_flag")


@query(_LEDGER + "select event_id, sha256(concat_ws('|', step, type, amount, nameOrig, nameDest)) as txn_id from ledger")
def ledger_txn_id(spark, sf_dir):
    return add_ledger_rowwise(adapters.ledger(spark, sf_dir)).select("event_id", "txn_id")


@query(_LEDGER + "select case when step <= 500 then 'train' when step <= 600 then 'valid' else 'test' end as split, count(*) as n from ledger group by 1")
def ledger_split_counts(spark, sf_dir):
    return adapters.ledger(spark, sf_dir).groupBy(split_column().alias("split")).agg(F.count("*").alias("n"))


_PRIOR = "window f as (partition by nameDest order by step range between unbounded preceding and 1 preceding)"


@query(_LEDGER + f""", h as (
  select event_id, step, amount, count(*) over f as n, coalesce(sum(amount) over f, 0.0) as s, avg(amount) over f as m, stddev_samp(amount) over f as sd, max(amount) over f as mx, max(step) over f as last
  from ledger {_PRIOR})
select event_id, cast(n as int) as dest_prior_txn_count, {_FLAG.format('n = 0')} as dest_first_seen_flag, s as dest_prior_amount_sum, m as dest_prior_amount_mean, round(sd, 6) as dest_prior_amount_std,
       mx as dest_prior_amount_max, cast(case when n > 0 then step - last end as int) as dest_steps_since_last_txn, round(case when n >= 3 and sd > 1e-5 then (amount - m) / sd end, 6) as dest_amount_zscore from h""")
def ledger_prior_history(spark, sf_dir):
    out = add_ledger_history(adapters.ledger(spark, sf_dir)).select("event_id", "dest_prior_txn_count", "dest_first_seen_flag", "dest_prior_amount_sum", "dest_prior_amount_mean", "dest_prior_amount_std", "dest_prior_amount_max", "dest_steps_since_last_txn", "dest_amount_zscore")
    return _rounded(out, "dest_prior_amount_std", "dest_amount_zscore")


@query(_LEDGER + f"""select event_id, cast(count(*) over d as int) as dest_txn_count_prev_24h, cast(count(*) over w as int) as dest_txn_count_prev_168h, coalesce(sum(amount) over d, 0.0) as dest_amount_sum_prev_24h,
  coalesce(sum(amount) over w, 0.0) as dest_amount_sum_prev_168h, case when count(*) over f > 0 then sum(case when type = 'CASH_OUT' then 1 else 0 end) over f / count(*) over f end as dest_prior_cashout_share from ledger
{_PRIOR}, d as (partition by nameDest order by step range between 24 preceding and 1 preceding), w as (partition by nameDest order by step range between 168 preceding and 1 preceding)""")
def ledger_velocity(spark, sf_dir):
    return add_ledger_history(adapters.ledger(spark, sf_dir)).select("event_id", "dest_txn_count_prev_24h", "dest_txn_count_prev_168h", "dest_amount_sum_prev_24h", "dest_amount_sum_prev_168h", "dest_prior_cashout_share")


def _joined(names, key: str) -> str:
    """The SQL of several queries by row, side by side."""
    return " join ".join(f"({ORACLES[n]})" if i == 0 else f"({ORACLES[n]}) using ({key})" for i, n in enumerate(names))


@query("select *, 'v1.0' as feature_version from " + _joined(("ledger_rowwise", "ledger_tier_b", "ledger_txn_id", "ledger_prior_history", "ledger_velocity"), "event_id"))
def ledger_full_features(spark, sf_dir):
    """Every feature of the whole ledger plan (row-wise, history, version), row by row."""
    df = adapters.ledger(spark, sf_dir)
    out = ledger_features(df).drop(*(c for c in df.columns if c != "event_id"))
    return _rounded(out, "hour_sin", "hour_cos", "amount_log1p", "amt_to_oldbalOrg", "amt_to_oldbalDest", "dest_prior_amount_std", "dest_amount_zscore")


_IND = ("addr1", "dist1", "P_emaildomain", "D2", "D15", "M1")
_IND_NAMES = {"addr1": "addr", "dist1": "dist1", "P_emaildomain": "Pemail", "D2": "D2", "D15": "D15", "M1": "M1_3"}


@query(_CARD + "select TransactionID, cast((DeviceType is not null)::int + (DeviceInfo is not null)::int + (id_01 is not null)::int as int) as identity_nonnull_count, " + _flags(has_identity_flag="DeviceType is not null or DeviceInfo is not null or id_01 is not null", **{f"ind_{_IND_NAMES[c]}": f"{c} is not null" for c in _IND}) + ", ((DeviceType is not null)::int + (DeviceInfo is not null)::int + (id_01 is not null)::int) / 40.0::double as identity_completeness from card")
def card_missingness(spark, sf_dir):
    return add_card_rowwise(adapters.card(spark, sf_dir)).select("TransactionID", "identity_nonnull_count", "has_identity_flag", "identity_completeness", *(f"ind_{_IND_NAMES[c]}" for c in _IND))


@query(_CARD + ", k as (select *, sha256(concat_ws('_', card1, coalesce(card2::varchar, 'NA'), card3, coalesce(card4, 'NA'), card5, card6)) as card_proxy_id from card) select TransactionID, card_proxy_id, sha256(concat_ws('_', card_proxy_id, coalesce(addr1::varchar, 'NA'))) as card_addr_proxy_id from k")
def card_proxy_keys(spark, sf_dir):
    return add_card_rowwise(adapters.card(spark, sf_dir)).select("TransactionID", "card_proxy_id", "card_addr_proxy_id")


@query(_CARD + "select TransactionID, cast(floor(TransactionDT / 3600) % 24 as int) as hour_of_day, cast(floor(TransactionDT / 86400) as int) as day_index, cast(cast(floor(TransactionDT / 86400) as int) % 7 as int) as day_of_week_rel, case when TransactionDT <= 130.0 * 86400 then 'train' else 'valid' end as split, round(ln(1 + greatest(0.0, TransactionAmt)), 6) as amt_log1p, cast(round((TransactionAmt - floor(TransactionAmt)) * 100) as int) as amt_cents, " + _flags(history_window_complete_flag="floor(TransactionDT / 86400) >= 7", amt_decimals_gt2_flag="abs(TransactionAmt * 100 - round(TransactionAmt * 100)) > 1e-4", amt_is_whole_flag="TransactionAmt = floor(TransactionAmt)") + " from card")
def card_temporal_amount(spark, sf_dir):
    return _rounded(add_card_rowwise(adapters.card(spark, sf_dir)).select("TransactionID", "hour_of_day", "day_index", "day_of_week_rel", "history_window_complete_flag", "split", "amt_log1p", "amt_cents", "amt_decimals_gt2_flag", "amt_is_whole_flag"), "amt_log1p")


def _times(names, test):
    return " + ".join(f"(case when {test.format(c)} then 1 else 0 end)" for c in names)


@query(_CARD + f"""select TransactionID, cast({_times(('M1', 'M2', 'M4'), "{} = 'T'")} as int) as m_true_cnt, cast({_times(('M1', 'M2', 'M4'), "{} = 'F'")} as int) as m_false_cnt, cast({_times(('M1', 'M2', 'M4'), '{} is null')} as int) as m_null_cnt,
  round(ln(1 + greatest(0.0, coalesce(C1, 0) + coalesce(C2, 0))), 6) as c_sum_log1p, cast({_times(('C1', 'C2'), 'coalesce({}, 0) > 0')} as int) as c_nonzero_cnt, greatest(coalesce(C1, 0.0), coalesce(C2, 0.0)) as c_max,
  cast({_times(('D1', 'D2', 'D15'), '{} is not null')} as int) as d_nonnull_cnt, cast(least(coalesce(D1, 999999.0), coalesce(D2, 999999.0), coalesce(D15, 999999.0)) as double) as d_min, cast(greatest(coalesce(D1, -999999.0), coalesce(D2, -999999.0), coalesce(D15, -999999.0)) as double) as d_max from card""")
def card_masked_aggregates(spark, sf_dir):
    return _rounded(add_card_rowwise(adapters.card(spark, sf_dir)).select("TransactionID", "m_true_cnt", "m_false_cnt", "m_null_cnt", "c_sum_log1p", "c_nonzero_cnt", "c_max", "d_nonnull_cnt", "d_min", "d_max"), "c_sum_log1p")


_CARD_KEY = "sha256(concat_ws('_', card1, coalesce(card2::varchar, 'NA'), card3, coalesce(card4, 'NA'), card5, card6))"


@query(_CARD + f""", h as (
  select TransactionID, TransactionDT, TransactionAmt, count(*) over f as n, coalesce(sum(TransactionAmt) over f, 0.0) as s, avg(TransactionAmt) over f as m, stddev_samp(TransactionAmt) over f as sd, max(TransactionAmt) over f as mx, lag(TransactionDT) over g as last
  from card window f as (partition by {_CARD_KEY} order by TransactionDT, TransactionID rows between unbounded preceding and 1 preceding), g as (partition by {_CARD_KEY} order by TransactionDT, TransactionID))
select TransactionID, cast(n as int) as card_prior_txn_count, {_FLAG.format('n = 0')} as card_first_seen_flag, s as card_prior_amt_sum, m as card_prior_amt_mean, round(sd, 3) as card_prior_amt_std, mx as card_prior_amt_max,
       cast(case when n > 0 then TransactionDT - last end as int) as card_secs_since_last_txn, round(case when n >= 3 and sd > 1e-5 then (TransactionAmt - m) / sd end, 6) as amt_zscore_vs_card from h""")
def card_prior_history(spark, sf_dir):
    out = add_card_history(add_card_rowwise(adapters.card(spark, sf_dir))).select("TransactionID", "card_prior_txn_count", "card_first_seen_flag", "card_prior_amt_sum", "card_prior_amt_mean", "card_prior_amt_std", "card_prior_amt_max", "card_secs_since_last_txn", "amt_zscore_vs_card")
    return _rounded(_rounded(out, "amt_zscore_vs_card"), "card_prior_amt_std", digits=3)  # amounts have eight digits


_CLOCK = "with t as (select event_id, user_id, cast(floor((epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000) as bigint) as sec, cast(round(value * 100) as double) as amount from events) "


def _events_in_seconds(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01', cast(ts as timestamp_ntz))").alias("sec"), F.round(F.col("value") * 100).cast("double").alias("amount"))


@query(_CLOCK + "select event_id, " + ", ".join(f"cast(count(*) over (partition by user_id order by sec range between {w} preceding and 1 preceding) as int) as {name}" for name, w in (("n_1h", 3600), ("n_24h", 86400), ("n_7d", 604800))) + " from t")
def card_velocity(spark, sf_dir):
    return _rolling(_events_in_seconds(spark, sf_dir), "user_id", "sec", "event_id", {"n_1h": 3600, "n_24h": 86400, "n_7d": 604800}).select("event_id", "n_1h", "n_24h", "n_7d")


def _rolling(df, entity, clock, tie, counts, sums=None):
    names = {k: f"h_{k}" for k in ("count", "first", "sum", "mean", "std", "max", "since", "zscore")}
    return add_history(df, History(entity, clock, "amount", tie, names, counts, sums or {}))


@query(_CARD + "select TransactionID, " + ", ".join(f"cast(count(*) over (partition by card1 order by TransactionDT range between {d * 86400} preceding and 1 preceding) as int) as n_{d}d" for d in (30, 90, 365)) + " from card")
def card_velocity_long(spark, sf_dir):
    df = adapters.card(spark, sf_dir).withColumnRenamed("TransactionAmt", "amount")
    return _rolling(df, "card1", "TransactionDT", "TransactionID", {f"n_{d}d": d * 86400 for d in (30, 90, 365)}).select("TransactionID", "n_30d", "n_90d", "n_365d")


@query(_CARD + ", " + ", ".join(f"round({f}((floor(TransactionDT / 3600) % 24) * (2 * pi() / 24)), 6) + 0.0::double as hour_{f}" for f in ("sin", "cos")).join(("w as (select TransactionID, ", " from card) select * from w")))
def card_clock(spark, sf_dir):
    return _rounded(add_card_rowwise(adapters.card(spark, sf_dir)).select("TransactionID", "hour_sin", "hour_cos"), "hour_sin", "hour_cos")


@query(_CARD + "select TransactionID, " + ", ".join(f"cast(count(*) over (partition by {_CARD_KEY} order by TransactionDT range between {w} preceding and 1 preceding) as int) as card_txn_count_{n}" for n, w in (("1h", 3600), ("24h", 86400), ("7d", 604800))) + " from card")
def card_rolling_counts(spark, sf_dir):
    return add_card_history(add_card_rowwise(adapters.card(spark, sf_dir))).select("TransactionID", "card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d")


@query("select *, 'v1.0' as feature_version from " + _joined(("card_missingness", "card_proxy_keys", "card_clock", "card_temporal_amount", "card_masked_aggregates", "card_prior_history", "card_rolling_counts"), "TransactionID"))
def card_full_features(spark, sf_dir):
    """Every feature of the whole card plan (row-wise, history, pruning, version), row by row."""
    df = adapters.card(spark, sf_dir)
    out = card_features(df).drop(*(c for c in df.columns if c != "TransactionID"))
    return _rounded(out, "hour_sin", "hour_cos", "amt_log1p", "c_sum_log1p", "amt_zscore_vs_card").withColumn("card_prior_amt_std", F.round("card_prior_amt_std", 3) + F.lit(0.0))


@query(f"with wide as ({adapters.WIDE_SQL}) select TransactionID, " + _flags(**{f"ind_{n}": f"{c} is not null" for n, c in INDICATORS.items()}) + " from wide")
def card_indicators(spark, sf_dir):
    """All missingness indicators, after near-constant columns (V1, the source of one, among them) are pruned."""
    return prune_near_constant(add_card_rowwise(adapters.wide(spark, sf_dir))).select("TransactionID", *(f"ind_{n}" for n in INDICATORS))


@query("select t.o_orderkey, t.o_totalprice, c.c_mktsegment, c.c_acctbal from orders t left join customer c on t.o_custkey = c.c_custkey")
def identity_left_join(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return _read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_totalprice", "c_mktsegment", "c_acctbal")


@query("with e as (select case when event_id % 13 = 0 then null else event_id end as id, case when event_id % 17 = 0 then null when event_id % 19 = 0 then 'nan'::double else value end as value from events) select count(*) as n_rows, (select count(*) from (select distinct id from e)) as distinct_ids, cast(count(*) - count(id) as int) as null_id, count(value) as present_value, sum(case when isnan(value) then 1 else 0 end)::bigint as nan_value from e")
def quality_report(spark, sf_dir):
    k = F.col("event_id")
    e = _read(spark, sf_dir, "events").select(F.when(k % 13 != 0, k).alias("id"), F.when(k % 17 != 0, F.when(k % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value"))).alias("value"))
    q = quality_counts(e, "id", ["id"])
    return q.select(F.col("rows").alias("n_rows"), "distinct_ids", F.col("`null:id`").cast("int").alias("null_id"), F.col("`present:value`").alias("present_value"), F.col("`nan:value`").alias("nan_value"))


_COLS = ("addr1", "dist1", "M1", "C1", "D2", "DeviceType")


@query(_CARD + " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count(*) - count({c}) as nulls, count(distinct {c}) as n_distinct from card" for c in _COLS))
def null_profile(spark, sf_dir):
    return profile.null_profile(adapters.card(spark, sf_dir), list(_COLS)).select("column", F.col("rows").alias("n_rows"), "nulls", F.col("distinct").alias("n_distinct"))


@query("select n, count(*) as keys from (select o_custkey, count(*) as n from orders group by o_custkey) group by n")
def value_histogram(spark, sf_dir):
    return profile.value_histogram(_read(spark, sf_dir, "orders"), "o_custkey")


@query(_LEDGER + ", v as (select step, count(*) as n from ledger group by step) select case when n < 5 then '<5' when n < 15 then '5-14' else '15+' end as bucket, min(n) as least, count(*) as steps, sum(n)::bigint as n_rows from v group by 1")
def bucket_counts(spark, sf_dir):
    v = adapters.ledger(spark, sf_dir).groupBy("step").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") < 5, "<5").when(F.col("n") < 15, "5-14").otherwise("15+")
    return v.groupBy(bucket.alias("bucket")).agg(F.min("n").alias("least"), F.count("*").alias("steps"), F.sum("n").alias("n_rows"))


@query(_CARD + "select count(*) filter (where dist1 is null) as n_null, count(*) filter (where dist1 is not null) as n_present, round(avg(isFraud) filter (where dist1 is null) * 100, 6) as rate_null, round(avg(isFraud) filter (where dist1 is not null) * 100, 6) as rate_present, round(avg(isFraud) filter (where dist1 is null) * 100 / 3.499, 6) as lift_null, round(avg(isFraud) filter (where dist1 is not null) * 100 / 3.499, 6) as lift_present from card")
def filtered_rate_lift(spark, sf_dir):
    return _rounded(profile.rate_lift(adapters.card(spark, sf_dir), "dist1", "isFraud", 3.499), "rate_null", "rate_present", "lift_null", "lift_present")


@query(_CARD + "select count(*) filter (where TransactionAmt < 0 or C1 < 0) as negative, count(*) filter (where DeviceType is not null or DeviceInfo is not null or id_01 is not null) as with_identity, (select count(*) from (select distinct * exclude (TransactionID) from card)) as distinct_rows from card")
def table_audit(spark, sf_dir):
    df = adapters.card(spark, sf_dir)
    present = F.col("DeviceType").isNotNull() | F.col("DeviceInfo").isNotNull() | F.col("id_01").isNotNull()
    distinct = df.drop("TransactionID").distinct().agg(F.count("*").alias("distinct_rows"))
    return df.agg(F.count_if((F.col("TransactionAmt") < 0) | (F.col("C1") < 0)).alias("negative"), F.count_if(present).alias("with_identity")).crossJoin(F.broadcast(distinct))  # two single rows


_NUMERIC = ("TransactionAmt", "C1", "D1", "D2")


@query(_CARD + " union all ".join(f"select '{c}' as \"column\", count({c}) as n, min({c})::double as min, max({c})::double as max, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std, round(quantile_cont({c}, 0.5), 6)::double as median, round(count(*) filter (where {c} = 0) / count({c}), 6) as zero_share, round(count(*) filter (where {c} < 0) / count({c}), 6) as negative_share, bool_and({c} = floor({c})) as all_integer from card" for c in _NUMERIC))
def column_profile(spark, sf_dir):
    return _rounded(profile.numeric_profile(adapters.card(spark, sf_dir), list(_NUMERIC)), "mean", "std", "median", "zero_share", "negative_share")


@query(_CARD + ", c as (" + " union all ".join(f"select '{c}' as \"column\", {c}::varchar as value, count(*) as n from card where {c} is not null group by {c}" for c in ("M1", "card6", "card4")) + ") select \"column\", value, n, round(n / sum(n) over (partition by \"column\"), 6) as share, cast(row_number() over (partition by \"column\" order by n desc, value) as int) as place from c qualify place <= 5")
def top_values(spark, sf_dir):
    return _rounded(profile.top_values(adapters.card(spark, sf_dir), ["M1", "card6", "card4"]), "share")


@query(_CARD + ", r as (select isFraud, count(*) over (order by D1) - (count(*) over (partition by D1) - 1) / 2.0 as rank from card where D1 is not null) select round(((sum(rank) filter (where isFraud = 1)) - sum(isFraud) * (sum(isFraud) + 1) / 2.0) / (sum(isFraud) * count(*) filter (where isFraud = 0)), 6)::double as auc from r")
def rank_auc(spark, sf_dir):
    return _rounded(profile.rank_auc(adapters.card(spark, sf_dir), "D1", "isFraud"), "auc")


@query(_CARD + "select round(corr(TransactionAmt, isFraud), 6) as r from card")
def pearson_label(spark, sf_dir):
    return adapters.card(spark, sf_dir).agg(F.round(profile.correlation("TransactionAmt", "isFraud"), 6).alias("r"))


_MASKED = ("addr1", "dist1", "M1", "M4", "C1", "C2", "D1", "D15", "DeviceType", "id_01", "ProductCD")


@query(_CARD + ", m as (" + " union all ".join(f"select '{c}' as c, count(*) filter (where {c} is null) as nulls, count(*) as n, coalesce(md5(string_agg(TransactionID::varchar, ',' order by TransactionID) filter (where {c} is null)), '') as mask, avg(isFraud) filter (where {c} is null) * 100 as rate_null, avg(isFraud) filter (where {c} is not null) * 100 as rate_present from card" for c in _MASKED) + """), g as (
  select string_agg(c, ',' order by regexp_extract(c, '^[^0-9]+'), try_cast(regexp_extract(c, '[0-9]+') as int)) as columns, min(c) as first, cast(count(*) as int) as n_columns, any_value(nulls) as nulls, 100.0::double * any_value(nulls) / any_value(n) as null_percent, round(any_value(rate_null), 6) as rate_null, round(any_value(rate_present), 6) as rate_present
  from m group by mask)
select 'MG' || lpad((row_number() over (order by nulls, first) - 1)::varchar, 2, '0') as "group", columns, n_columns, nulls, round(null_percent, 6) as null_percent, null_percent >= 5 and null_percent < 99.5 as indicator_recommended, rate_null, rate_present from g""")
def null_mask_groups(spark, sf_dir):
    return _rounded(profile.null_mask_groups(adapters.card(spark, sf_dir), "TransactionID", list(_MASKED), "isFraud"), "null_percent", "rate_null", "rate_present")


_TREATED = ("TransactionID", "isFraud", "TransactionAmt", "M1", "card4", "dist1", "D2", "D15", "C2", "id_01", "DeviceType")


def _described_sql(c: str) -> str:
    auc = "null::double" if c in ("M1", "card4", "DeviceType") else f"(select case when count(distinct {c}) > 1 and sum(isFraud) > 0 and sum(isFraud) < count(*) then ((sum(rank) filter (where isFraud = 1)) - sum(isFraud) * (sum(isFraud) + 1) / 2.0) / (sum(isFraud) * count(*) filter (where isFraud = 0)) end from (select {c}, isFraud, count(*) over (order by {c}) - (count(*) over (partition by {c}) - 1) / 2.0 as rank from card where {c} is not null))"
    return f"select '{c}' as \"column\", 100.0::double * count(*) filter (where {c} is null) / count(*) as null_percent, avg(isFraud) filter (where {c} is null) * 100 as rate_null, avg(isFraud) filter (where {c} is not null) * 100 as rate_present, (select max(n) from (select count(*) as n from card where {c} is not null group by {c})) as most, count({c}) as present, {auc}::double as auc from card"


@query(_CARD + ", p as (" + " union all ".join(map(_described_sql, _TREATED)) + """), d as (select *, 100.0::double * most / present as top_share, present - most as minority, "column" in ('M1', 'card4', 'DeviceType') as cat from p)
select "column", round(null_percent, 6) as null_percent, round(rate_null, 6) as rate_null, round(rate_present, 6) as rate_present, round(top_share, 6) as top_share, minority, round(auc, 6) as auc,
  case when "column" = 'TransactionID' then 'EXCLUDE_IDENTIFIER' when "column" = 'isFraud' then 'TARGET' when top_share >= 99 and not cat and minority >= 500 then '1_KEEP_IMPUTE' when top_share >= 99 and not cat then '4_DROP_LOW_INFO'
    when cat then '3_KEEP_CATEGORICAL' when null_percent < 1 then '1_KEEP_IMPUTE' when null_percent >= 99 and abs(auc - 0.5) >= 0.05 then '5_NEEDS_INVESTIGATION' when null_percent >= 99 then '4_DROP_LOW_INFO'
    when null_percent >= 5 and coalesce(abs(rate_null - rate_present), 0) >= 2 then '2_KEEP_MISSING_INDICATOR' else '1_KEEP_IMPUTE' end as treatment,
  case "column" when 'TransactionID' then 'identifier' when 'isFraud' then 'target' when 'TransactionAmt' then 'numeric-continuous; log1p; amount decimals' when 'M1' then 'categorical-binary (T/F) or M0/M1/M2' when 'dist1' then 'numeric-continuous' when 'D2' then 'numeric-timedelta' when 'D15' then 'numeric-timedelta' when 'C2' then 'numeric-count; heavy tail -> log1p' when 'id_01' then 'numeric' else 'categorical-low-card' end as role
from d""")
def column_treatment(spark, sf_dir):
    """Missing share, label rates, dominant value and AUC of columns; the treatment and the role that follow."""
    done = profile.with_roles(profile.describe_columns(adapters.card(spark, sf_dir), list(_TREATED), "isFraud")).withColumn("treatment", profile.treatment()).drop("family")
    return _rounded(done, "null_percent", "rate_null", "rate_present", "top_share", "auc")


@query(_CARD + ", r as (" + " union all ".join(f"select '{c}' as \"column\", avg(isFraud) * 100 as rate from card where {c} is not null group by {c} having count(*) >= 100" for c in ("card4", "card6", "M1")) + ") select \"column\", round(max(rate), 6) as highest, round(min(rate), 6) as lowest from r group by 1")
def category_rates(spark, sf_dir):
    return _rounded(profile.category_rates(adapters.card(spark, sf_dir), ["card4", "card6", "M1"], "isFraud", 100), "highest", "lowest")


@query(_CARD + ", b as (select TransactionID::double as a, 2.0 * TransactionID + (TransactionID % 5) as b, TransactionAmt as c, 7.0 as d from card), r as (select round(abs(corr(a, b)), 6) as ab, round(abs(corr(a, c)), 6) as ac from b) select 'a' as \"column\", 'a' as representative, 1.0::double as abs_r union all select 'b', case when ab >= 0.98 then 'a' else 'b' end, case when ab >= 0.98 then ab else 1.0 end from r union all select 'c', case when ac >= 0.98 then 'a' else 'c' end, case when ac >= 0.98 then ac else 1.0 end from r union all select 'd', 'CONSTANT_IN_SAMPLE', null")
def correlation_clusters(spark, sf_dir):
    k = F.col("TransactionID")
    df = adapters.card(spark, sf_dir).select(k.cast("double").alias("a"), (2.0 * k + k % 5).alias("b"), F.col("TransactionAmt").alias("c"), F.lit(7.0).alias("d"))
    return _rounded(profile.correlation_clusters(df, [["a", "b", "c", "d"]], fraction=1.0), "abs_r")


@query("""with o as (select o_custkey, (o_orderdate::date - date '1992-01-01') * 86400 as clock, o_orderkey from orders where o_custkey is not null), v as (select *, count(*) over (partition by o_custkey order by clock range between 604800 preceding and 1 preceding) as v from o),
s as (select o_custkey, count(*) as n, max(clock) - min(clock) as span, max(v) as peak from v group by o_custkey),
t as (select o_custkey, count(*) as groups from (select o_custkey from o group by o_custkey, clock having count(*) > 1) group by o_custkey),
a as (select o_custkey, n, 'A' as list, row_number() over (order by peak desc, o_custkey) as place from s qualify place <= 10),
b as (select o_custkey, n, 'B' as list, row_number() over (order by groups desc, o_custkey) as place from t join s using (o_custkey) where o_custkey not in (select o_custkey from a) qualify place <= 30),
c as (select o_custkey, n, 'C' as list, row_number() over (order by n desc, o_custkey) as place from s where span >= 30 * 86400 and n >= 10 and o_custkey not in (select o_custkey from a) and o_custkey not in (select o_custkey from b) qualify place <= 30)
select o_custkey, n as n_rows, list, cast(place as int) as place from (from a union all from b union all from c)""")
def subset_selection(spark, sf_dir):
    """All three lists with their places: highest 7-day count, most ties (orders of one day), most rows of those with long spans. No customer has 200 orders, so list C takes those with 10."""
    df = _read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lit(1.0).alias("amount"), F.expr("timestampdiff(SECOND, timestamp_ntz'1992-01-01', cast(o_orderdate as timestamp_ntz))").alias("clock"))
    df = _rolling(df, "o_custkey", "clock", "o_orderkey", {"v": 604800})
    return subset.rank_entities(df, "o_custkey", "clock", "v", min_rows=10).select("o_custkey", F.col("rows").alias("n_rows"), "list", "place")


@query("select o.o_orderkey from orders o semi join customer c on o.o_custkey = c.c_custkey and c.c_mktsegment = 'BUILDING'")
def membership_filter(spark, sf_dir):
    keys = _read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return _read(spark, sf_dir, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey")


@query(_CARD + ", t as (select card4 as value, count(*) / (select count(*) from card where TransactionID % 3 = 0) as share from card where TransactionID % 3 = 0 group by card4) select TransactionID, round(coalesce(share, 0), 6)::double as card4_share from card left join t on card4 is not distinct from value")
def frequency_encoding(spark, sf_dir):
    """Shares of the card's network among training rows, broadcast to all rows."""
    df = adapters.card(spark, sf_dir).select("TransactionID", "card4")
    return _rounded(frequency_encode(df, df.where("TransactionID % 3 = 0"), "card4"), "card4_share").select("TransactionID", "card4_share")


_SCORED = "with s as (select case when event_id % 7 = 0 then 1 else 0 end as y, ((event_id * 37) % 101) / 100.0::double as score from events) "


def _scored(spark, sf_dir):
    return _read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, 1).otherwise(0).alias("y"), ((F.col("event_id") * 37) % 101 / F.lit(100.0)).alias("score"))


def _counts_sql(t: str) -> str:
    return f"count(*) filter (where score < {t} and y = 0) as tn, count(*) filter (where score >= {t} and y = 0) as fp, count(*) filter (where score < {t} and y = 1) as fn, count(*) filter (where score >= {t} and y = 1) as tp"


@query(_SCORED + f"select {_counts_sql('0.5')} from s")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_scored(spark, sf_dir), "y", "score").select("tn", "fp", "fn", "tp")


@query(_SCORED + f", t as (select unnest([0.105, 0.305, 0.505, 0.705, 0.905])::double as threshold), c as (select threshold, {_counts_sql('threshold')} from s, t group by threshold) select *, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1 from c")
def threshold_sweep(spark, sf_dir):
    return _rounded(metrics.sweep(_scored(spark, sf_dir), "y", "score", [0.105, 0.305, 0.505, 0.705, 0.905]), "precision", "recall", "f1")


@query(_SCORED + ", g as (select score, sum(y) as p, count(*) as n from s group by score), c as (select p, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as k from g) select round(sum(p * tp / k) / sum(p), 6)::double as average_precision from c")
def average_precision(spark, sf_dir):
    return _rounded(metrics.average_precision(_scored(spark, sf_dir), "y", "score"), "average_precision")


@query(_LEDGER + "select case when event_id % 10 = 1 then 'NEGATIVE_AMOUNT' when event_id % 10 = 2 then 'MISSING_FIELD' when event_id % 10 = 3 then 'BAD_TYPE' when event_id % 10 = 4 then 'MALFORMED_JSON' when event_id % 10 = 5 then 'BAD_STEP_TYPE' when event_id % 10 = 6 then 'INVALID_STEP' when event_id % 10 = 7 then 'INVALID_LABEL' when event_id % 10 = 8 then 'BAD_FIELD_TYPE' else 'VALID' end as reason, count(*) as n from ledger group by 1")
def dlq_classification_ledger(spark, sf_dir):
    k = F.col("event_id") % 10
    fields = F.struct(
        F.when(k == 5, F.lit("ten").cast("variant")).when(k == 6, F.lit(800).cast("variant")).otherwise(F.col("step").cast("variant")).alias("step"),
        F.when(k == 3, "TELEPORT").otherwise(F.col("type")).alias("type"),
        F.when(k == 1, F.lit(-50.0).cast("variant")).when(k == 8, F.lit("many").cast("variant")).otherwise(F.col("amount").cast("variant")).alias("amount"),
        F.when(k != 2, F.col("nameOrig")).alias("nameOrig"), "nameDest", F.when(k == 7, 99).otherwise(F.col("isFraud")).alias("isFraud"),
    )
    raw = adapters.ledger(spark, sf_dir).select(F.when(k == 4, "{not json").otherwise(F.to_json(fields)).alias("value"))
    return _reasons(raw, dlq.ledger_reason)


@query(_CARD + "select case when TransactionID % 8 = 1 then 'NEGATIVE_AMOUNT' when TransactionID % 8 = 2 then 'MISSING_FIELD' when TransactionID % 8 = 3 then 'BAD_FIELD_TYPE' when TransactionID % 8 = 4 then 'MALFORMED_JSON' when TransactionID % 8 = 5 then 'INVALID_LABEL' when TransactionID % 8 = 6 then 'INVALID_TRANSACTIONDT' else 'VALID' end as reason, count(*) as n from card group by 1")
def dlq_classification_card(spark, sf_dir):
    k = F.col("TransactionID") % 8
    fields = F.struct(
        "TransactionID", F.when(k == 5, 7).otherwise(F.col("isFraud")).alias("isFraud"), F.when(k == 6, 0).otherwise(F.abs("TransactionDT") + 1).alias("TransactionDT"),
        F.when(k == 1, F.lit(-1.0)).otherwise(F.col("TransactionAmt")).alias("TransactionAmt"), F.when(k == 3, F.lit(5).cast("variant")).otherwise(F.col("ProductCD").cast("variant")).alias("ProductCD"), F.when(k != 2, F.col("card1")).alias("card1"),
    )
    raw = adapters.card(spark, sf_dir).select(F.when(k == 4, "[1, 2]").otherwise(F.to_json(fields)).alias("value"))
    return _reasons(raw, dlq.card_reason)


# Half of all rows are one entity's.
_HOT_LEDGER = f"with raw as ({adapters.LEDGER_SQL}), ledger as (select * replace (case when event_id % 2 = 0 then 'hot' else nameDest end as nameDest) from raw) "
_HOT_KEYS = {"card1": "1", "card2": "null", "card4": "null", "card5": "100", "card6": "'debit'"}
_HOT_CARD = f"with raw as ({adapters.CARD_SQL}), card as (select * replace ({', '.join(f'case when TransactionID % 2 = 0 then {v} else {c} end as {c}' for c, v in _HOT_KEYS.items())}) from raw) "
#: Items of a block in these queries: so few that the hot entity lies in many.
_SMALL_BLOCK = 2000


@query(f"select * from {_joined(('ledger_prior_history', 'ledger_velocity'), 'event_id')}".replace(_LEDGER, _HOT_LEDGER))
def history_in_blocks_ledger(spark, sf_dir):
    """The ledger's history where half of all rows are one account's, by ticks and blocks."""
    df = adapters.ledger(spark, sf_dir).withColumn("nameDest", F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("nameDest")))
    h = replace(LEDGER, shares={"dest_prior_cashout_share": F.col("type") == "CASH_OUT"})
    names = [*h.names.values(), *h.rolling_counts, *h.rolling_sums, *h.shares]
    return _rounded(add_history_in_blocks(df, h, block_rows=_SMALL_BLOCK).select("event_id", *names), "dest_prior_amount_std", "dest_amount_zscore")


@query(f"select * from {_joined(('card_prior_history', 'card_rolling_counts'), 'TransactionID')}".replace(_CARD, _HOT_CARD))
def history_in_blocks_card(spark, sf_dir):
    """The card's history where half of all rows are one card's, by rows, ticks and blocks."""
    df = adapters.card(spark, sf_dir)
    df = add_card_rowwise(df.withColumns({c: F.expr(f"case when TransactionID % 2 = 0 then {v} else {c} end") for c, v in _HOT_KEYS.items()}))
    out = add_history_in_blocks(df, CARD, block_rows=_SMALL_BLOCK).select("TransactionID", *CARD.names.values(), *CARD.rolling_counts)
    return _rounded(_rounded(out, "amt_zscore_vs_card"), "card_prior_amt_std", digits=3)


@query(_HOT_LEDGER + "select event_id, " + ", ".join(f"cast(count(distinct {c}) over (partition by nameDest order by step range between unbounded preceding and 1 preceding) as int) as {k}" for k, c in (("dest_prior_unique_senders", "sender"), ("dest_prior_unique_types", "type"))) + " from (select *, event_id % 700 as sender from ledger)")
def prior_distinct_ledger(spark, sf_dir):
    """How many senders and types an account had before each step, where half of all rows are one account's."""
    df = adapters.ledger(spark, sf_dir).withColumns({"nameDest": F.when(F.col("event_id") % 2 == 0, "hot").otherwise(F.col("nameDest")), "sender": F.col("event_id") % 700})
    counts = {"dest_prior_unique_senders": "sender", "dest_prior_unique_types": "type"}
    return add_prior_distinct(df, "nameDest", "step", counts, block_rows=_SMALL_BLOCK).select("event_id", *counts)


_DISTINCT_CARD = {"card_prior_distinct_addr1": "addr1", "card_prior_distinct_pemail": "P_emaildomain", "card_prior_distinct_device": "DeviceInfo"}


@query(_CARD + "select TransactionID, " + ", ".join(f"cast(count(distinct {c}) over (partition by card1 order by TransactionDT, TransactionID rows between unbounded preceding and 1 preceding) as int) as {k}" for k, c in _DISTINCT_CARD.items()) + " from card")
def prior_distinct_card(spark, sf_dir):
    """How many addresses, mail domains and devices a card had before each row."""
    df = adapters.card(spark, sf_dir)
    return add_prior_distinct(df, "card1", "TransactionDT", _DISTINCT_CARD, "TransactionID", block_rows=_SMALL_BLOCK).select("TransactionID", *_DISTINCT_CARD)


@query(_LEDGER + ", fitted as (select type, avg(amount) as m, stddev_samp(amount) as sd, quantile_disc(amount, 0.99) as p99 from ledger where step <= 500 group by type) "
       "select event_id, round(case when sd > 0 then (amount - m) / sd end, 6) + 0.0 as amount_z_by_type, cast(case when amount > p99 then 1 else 0 end as tinyint) as amount_pct_of_type_p99_flag from ledger left join fitted using (type)")  # fmt: skip
def train_fit_amount_by_type(spark, sf_dir):
    """Amounts against mean, deviation and 99th percentile of their type, fitted on the training rows alone."""
    df = adapters.ledger(spark, sf_dir).withColumn("split", split_column())
    return _rounded(add_amount_by_type(df).select("event_id", "amount_z_by_type", "amount_pct_of_type_p99_flag"), "amount_z_by_type")


# Records on the edges of the rules, with @ for the row's key (1 to 743) and what is said of them.
_GOOD = '{"step": %s, "type": "TRANSFER", "amount": %s, "nameOrig": "o@", "nameDest": "d", "isFraud": %s}'
_EDGES = (
    (_GOOD % ("@", "5.0", "0"), "VALID"), ("\t \r\n" + _GOOD % ("@", "5", "1") + " \n", "VALID"), (_GOOD % ("1", "5.0", "0") + _GOOD % ("@", "5.0", "0"), "MALFORMED_JSON"), (_GOOD % ("@", "5.0", "0") + " junk}", "MALFORMED_JSON"),
    (_GOOD % ("@", "5.0", "0") + "}", "MALFORMED_JSON"), (_GOOD % ("@", "5.0", "0") + ', "end": "x"}', "MALFORMED_JSON"), ("[" + _GOOD % ("@", "5.0", "0") + "]", "MALFORMED_JSON"), ("", "MALFORMED_JSON"), ("null", "MALFORMED_JSON"), (" " + _GOOD % ("@", "5.0", "0"), "MALFORMED_JSON"),
    (_GOOD % ("@.0", "5.0", "0"), "BAD_STEP_TYPE"), (_GOOD % ("@.5", "5.0", "0"), "BAD_STEP_TYPE"), (_GOOD % ("1e1", "5.0", "0"), "BAD_STEP_TYPE"), (_GOOD % ("1e400", "5.0", "0"), "BAD_STEP_TYPE"), (_GOOD % ("true", "5.0", "0"), "BAD_STEP_TYPE"), (_GOOD % ('"@"', "5.0", "0"), "BAD_STEP_TYPE"),
    (_GOOD % ("@" + "0" * 20, "5.0", "0"), "INVALID_STEP"), (_GOOD % ("-@" + "0" * 30, "5.0", "0"), "INVALID_STEP"), (_GOOD % ("@" + "0" * 400, "5.0", "0"), "INVALID_STEP"), (_GOOD % ("-0", "5.0", "0"), "INVALID_STEP"), (_GOOD % ("743", "5.0", "0"), "VALID"), (_GOOD % ("744", "5.0", "0"), "INVALID_STEP"), (_GOOD % ("null", "5.0", "0"), "MISSING_FIELD"),
    (_GOOD % ("@", "5.0", "1.0"), "BAD_FIELD_TYPE"), (_GOOD % ("@", "5.0", "1e0"), "BAD_FIELD_TYPE"), (_GOOD % ("@", "5.0", "true"), "BAD_FIELD_TYPE"), (_GOOD % ("@", "5.0", "1" + "0" * 20), "INVALID_LABEL"), (_GOOD % ("@", "1e400", "0"), "BAD_FIELD_TYPE"), (_GOOD % ("@", '"5"', "0"), "BAD_FIELD_TYPE"),
    (_GOOD % ("@", "-1e-300", "0"), "NEGATIVE_AMOUNT"), (_GOOD % ("@", "-0.0", "0"), "VALID"), (_GOOD % ("@", "1" + "0" * 60, "0"), "VALID"), (_GOOD % ("@", "5.0", "0, \"step\": 1"), "MALFORMED_JSON"),
)
_PAID = '{"TransactionID": %s, "TransactionDT": %s, "TransactionAmt": %s, "ProductCD": "W", "isFraud": %s, "card1": %s}'
# With the row's fields as they come out: TransactionID, TransactionDT, TransactionAmt, isFraud, card1.
_CARD_EDGES = (
    (_PAID % ("@", "86400.7", "5.5", "0", "7.9"), "VALID", "@", 86400, 5.5, 0, 7), (_PAID % ('"@"', '" 86400 "', '" 5.5 "', '"0"', '"7"'), "VALID", "@", 86400, 5.5, 0, 7), (_PAID % ("@.0", '"1_000"', '"1_0.5e1"', "1.0", "-7.9"), "VALID", "@", 1000, 105.0, 1, -7),
    (_PAID % ("@", "+5", "5.5", "0", "7"), "MALFORMED_JSON"), (_PAID % ("@", '"+5"', '"0"', "0", "7"), "VALID", "@", 5, 0.0, 0, 7), (_PAID % ("@", "true", "true", "true", "true"), "VALID", "@", 1, 1.0, 1, 1),
    (_PAID % ("@", "1e30", "5.5", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "-1e30", "5.5", "0", "7"), "INVALID_TRANSACTIONDT"), (_PAID % ("@", "1e400", "5.5", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "2147483647", "5.5", "0", "7"), "VALID", "@", 2147483647, 5.5, 0, 7), (_PAID % ("@", "2147483648", "5.5", "0", "7"), "BAD_FIELD_TYPE"),
    (_PAID % ("1e300", "5", "5.5", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("3000000000", "5", "5.5", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@" + "0" * 20, "5", "5.5", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ('"@.5"', "5", "5.5", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ('""', "5", "5.5", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("[1]", "5", "5.5", "0", "7"), "BAD_FIELD_TYPE"),
    (_PAID % ("@", "5", "5.5", "1e30", "7"), "INVALID_LABEL"), (_PAID % ("@", "5", "5.5", "1" + "0" * 400, "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "5", "5.5", "0.5", "7"), "VALID", "@", 5, 5.5, 0, 7), (_PAID % ("@", "5", "5.5", "-0.5", "7"), "VALID", "@", 5, 5.5, 0, 7), (_PAID % ("@", "0.9", "5.5", "0", "7"), "INVALID_TRANSACTIONDT"),
    (_PAID % ("@", "5", '"nan"', "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "5", '"inf"', "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "5", "1e400", "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "5", '"1e400"', "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "5", '"5.5.5"', "0", "7"), "BAD_FIELD_TYPE"), (_PAID % ("@", "5", "-5.5", "0", "7"), "NEGATIVE_AMOUNT"),
    (_PAID % ("@", "5", "5.5", "0", '"visa"'), "BAD_FIELD_TYPE"), (_PAID % ("@", "5", "5.5", "0", "null"), "MISSING_FIELD"), (_PAID % ("@", "5", "5.5", "2", "7"), "INVALID_LABEL"), (_PAID % ("@", "-5", "5.5", "0", "7"), "INVALID_TRANSACTIONDT"),
)


def _edge_records(spark, sf_dir, edges) -> DataFrame:
    """Each event as a record of the edge that its key falls to."""
    k = F.col("event_id")
    texts = F.array(*(F.lit(t) for t, *_ in edges))
    return _read(spark, sf_dir, "events").select(k.cast("string").alias("key"), F.replace(F.get(texts, (k % len(edges)).cast("int")), F.lit("@"), (k % 743 + 1).cast("string")).alias("value"))


def _edge_sql(edges, columns: str = "") -> str:
    reasons = ", ".join(f"'{e[1]}'" for e in edges)
    more = ""
    for i, (name, kind) in enumerate(c.split() for c in columns.split(", ") if c):
        values = ["null" if len(e) < 3 else "event_id % 743 + 1" if e[i + 2] == "@" else str(e[i + 2]) for e in edges]
        more += f", cast([{', '.join(values)}][event_id % {len(edges)} + 1] as {kind}) as {name}"
    return f"select event_id, [{reasons}][event_id % {len(edges)} + 1] as reason{more} from events"


@query(_edge_sql(_EDGES))
def dlq_edges_ledger(spark, sf_dir):
    """The reason of ledger records on the edges of the rules: text around the object, 5.0 and 1e1, numbers beyond 64 bits, booleans."""
    done = dlq.classify(_edge_records(spark, sf_dir, _EDGES), dlq.ledger_reason)
    return done.select(F.col("key").cast("long").alias("event_id"), F.coalesce("reason_code", F.lit("VALID")).alias("reason"))


@query(_edge_sql(_CARD_EDGES, "TransactionID int, TransactionDT int, TransactionAmt double, isFraud int, card1 int"))
def dlq_edges_card(spark, sf_dir):
    """The reason of card records on the edges of the rules, and the fields of the valid ones: none of them is null."""
    done = dlq.classify(_edge_records(spark, sf_dir, _CARD_EDGES), dlq.card_reason, dlq.card_fields)
    return done.select(F.col("key").cast("long").alias("event_id"), F.coalesce("reason_code", F.lit("VALID")).alias("reason"), *(f"judged.{c}" for c in ("TransactionID", "TransactionDT", "TransactionAmt", "isFraud", "card1")))


def _reasons(raw: DataFrame, reason) -> DataFrame:
    done = dlq.classify(raw.withColumn("key", F.lit(None).cast("string")), reason)
    return done.groupBy(F.coalesce("reason_code", F.lit("VALID")).alias("reason")).agg(F.count("*").alias("n"))


@query(_LEDGER + "select 'amount' as \"column\", count(*) as compared, count(*) filter (where event_id % 50 = 0) as mismatches from ledger union all select 'type', count(*), count(*) filter (where event_id % 70 = 0 or event_id % 90 = 1 and type <> 'DEBIT') from ledger union all select 'step', count(*), 0 from ledger")
def parity_check(spark, sf_dir):
    """The ledger against a copy with other amounts, and null and other types, in some rows."""
    a, k = adapters.ledger(spark, sf_dir).select("event_id", "amount", "type", "step"), F.col("event_id")
    b = a.select("event_id", F.when(k % 50 == 0, F.col("amount") + 1).otherwise(F.col("amount") + 1e-12).alias("amount"), F.when(k % 70 != 0, F.when(k % 90 == 1, "DEBIT").otherwise(F.col("type"))).alias("type"), "step")
    return parity(a, b, "event_id").select("column", "compared", "mismatches")


def _streamed(spark, rows: DataFrame, build, columns: str) -> DataFrame:
    """The rows sent as records through a streaming pipeline, from files to files, to its end."""
    from .session import STREAMING, shared_folder
    from .sources.streams import as_records, stream_source

    for k, v in STREAMING.items():
        spark.conf.set(k, v)
    at = shared_folder(spark, "stream")
    as_records(rows, None).write.json(f"{at}/in")
    out = build(stream_source(spark, "file", f"{at}/in")).where("reason_code is null")
    write = lambda batch, n: batch.selectExpr(*[c.split()[0] for c in columns.split(", ")]).write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    out.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(columns).parquet(f"{at}/out/*")


_LEDGER_STATE = "dest_prior_txn_count int, dest_first_seen_flag tinyint, dest_prior_amount_sum double, dest_prior_amount_mean double, dest_prior_amount_std double, dest_prior_amount_max double, dest_steps_since_last_txn int, dest_amount_zscore double, dest_txn_count_prev_24h int, dest_txn_count_prev_168h int, dest_amount_sum_prev_24h double, dest_amount_sum_prev_168h double, dest_prior_cashout_share double"
_CARD_STATE = "card_prior_txn_count int, card_first_seen_flag tinyint, card_prior_amt_sum double, card_prior_amt_mean double, card_prior_amt_std double, card_prior_amt_max double, card_secs_since_last_txn int, amt_zscore_vs_card double, card_txn_count_1h int, card_txn_count_24h int, card_txn_count_7d int"


def _near(df: DataFrame, state: str) -> DataFrame:
    # The card's amounts have eight digits, so their deviation has fewer behind the point.
    names = [c.split()[0] for c in state.split(", ") if c.endswith("double")]
    return _rounded(_rounded(df, *(c for c in names if c != "card_prior_amt_std")), *(c for c in names if c == "card_prior_amt_std"), digits=3)


def _near_sql(state: str) -> str:
    return ", ".join(f"round({n}, {3 if n == 'card_prior_amt_std' else 6}) as {n}" if k == "double" else n for n, k in map(str.split, state.split(", ")))


@query(f"select 'C' || event_id as nameOrig, {_near_sql(_LEDGER_STATE)} from {_joined(('ledger_prior_history', 'ledger_velocity'), 'event_id')}")
def stream_parity_ledger(spark, sf_dir):
    """Every output of the ledger's keyed state, held against the batch queries' SQL."""
    from .streaming.pipelines import ledger_stream

    return _near(_streamed(spark, adapters.ledger(spark, sf_dir).drop("event_id"), ledger_stream, f"nameOrig string, {_LEDGER_STATE}"), _LEDGER_STATE)


@query(f"select TransactionID, {_near_sql(_CARD_STATE)} from {_joined(('card_prior_history', 'card_rolling_counts'), 'TransactionID')}".replace("from orders\n", "from orders where o_orderdate > timestamp '1995-01-01'\n"))
def stream_parity_card(spark, sf_dir):
    """Every output of the card's keyed state over rows with a positive clock, held against the batch queries' SQL."""
    from .streaming.pipelines import card_stream

    rows = adapters.card(spark, sf_dir).where("TransactionDT > 0")
    return _near(_streamed(spark, rows, lambda r: card_stream(r, schema=rows.schema), f"TransactionID int, {_CARD_STATE}"), _CARD_STATE)


@query("select case when event_id % 5 = 0 then 'MALFORMED' when event_id % 5 = 1 then 'MISSING_KEY' when event_id % 5 = 2 then 'MISSING_FEATURES' when event_id % 5 = 3 then 'INVALID_NUMERIC_FEATURE' else 'SCORED' end as status, count(*) as n from events group by 1")
def score_status(spark, sf_dir):
    from .ml.score import score_status as status

    k = F.col("event_id") % 5
    fields = F.struct(F.when(k != 1, F.concat(F.lit("t"), F.col("event_id").cast("string"))).alias("txn_id"), F.when(k != 2, F.when(k == 3, "many").otherwise(F.col("value").cast("string"))).alias("amount"), F.lit(1).alias("step_hour"))
    records = _read(spark, sf_dir, "events").select(F.when(k == 0, "{broken").otherwise(F.to_json(fields)).alias("value"))
    return status(records, "txn_id", ["amount", "step_hour"]).groupBy("status").agg(F.count("*").alias("n"))


@query(_LEDGER + "select cast(type = 'TRANSFER' as int) as type_transfer, round(avg(isFraud), 3) as rate from ledger where step <= 500 group by 1")
def train_logistic(spark, sf_dir):
    """The logistic baseline on one binary feature without weights: its probabilities are the label's rates in the two groups."""
    from .ml import fit

    train = ledger_features(adapters.ledger(spark, sf_dir)).where("split = 'train'").persist()
    scored = fit(train, None, "ledger", weighting="unweighted", names=["type_transfer"]).predict(train.select("type_transfer"))
    done = scored.groupBy(F.col("type_transfer").cast("int").alias("type_transfer")).agg(F.round(F.avg("probability"), 3).alias("rate"))
    rows = spark.createDataFrame(done.collect(), done.schema)  # two rows
    train.unpersist()
    return rows


_BOOST = {"numeric": ["card5", "dist1", "C1", "D1", "D2", "D15", "id_01"], "strings": ["ProductCD", "card4", "card6", "M1", "M2", "M4", "DeviceType"]}
# Every split of every feature at the root of the first tree: each value (categories: each prefix by gradient), nulls left and right.
_SPLITS = (
    _CARD + ", rows as (select *, isFraud as y, case when isFraud = 1 then 2.0 else 1.0 end::double as w from card), base as (select sum(w * y) / sum(w) as p from rows), gh as (select rows.*, round((p - y) * w * 1048576)::hugeint as g, round(p * (1 - p) * w * 1048576)::hugeint as h from rows, base), "
    + "long as ("
    + " union all ".join([f"select {i} as feature, {c}::double as v, null::varchar as s, g, h from gh" for i, c in enumerate(_BOOST["numeric"])] + [f"select {len(_BOOST['numeric']) + i}, null, {c}, g, h from gh" for i, c in enumerate(_BOOST["strings"])])
    + "), sums as (select feature, v, s, v is null and s is null as absent, sum(g)::double as g, sum(h)::double as h, count(*) as n from long group by all), "
    + "so_far as (select *, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl from sums where not absent window w as (partition by feature order by coalesce(v, g / (h + 10 * 1048576.0)), s rows unbounded preceding)), "
    + "nulls as (select feature, sum(case when absent then g else 0 end) as gm, sum(case when absent then h else 0 end) as hm, sum(case when absent then n else 0 end) as nm, sum(g) as gt, sum(h) as ht, sum(n) as nt from sums group by feature), "
    + "splits as (select feature, side as missing_left, gl + case when side then gm else 0 end as gl, hl + case when side then hm else 0 end as hl, nl + case when side then nm else 0 end as n_left, gt, ht, nt from so_far join nulls using (feature), (values (true), (false)) t(side)), "
    + "gains as (select *, (gl / 1048576) ** 2 / (hl / 1048576 + 1) + ((gt - gl) / 1048576) ** 2 / ((ht - hl) / 1048576 + 1) - (gt / 1048576) ** 2 / (ht / 1048576 + 1) as gain from splits where least(n_left, nt - n_left) >= 20 and least(hl, ht - hl) >= 0.001 * 1048576) "
    + "select feature, missing_left, n_left::bigint as n_left, round(gain, 6) + 0.0 as gain from gains qualify row_number() over (partition by feature order by gain desc, missing_left desc, n_left) = 1"
)


@query(_SPLITS)
def boosted_root_splits(spark, sf_dir):
    """The best split of each feature at the root of the first boosted tree, against all splits of the values themselves."""
    from .ml import boosting

    rows = adapters.card(spark, sf_dir).withColumn("w", F.when(F.col("isFraud") == 1, 2.0).otherwise(1.0))
    share = rows.agg(F.sum(F.col("w") * F.col("isFraud")) / F.sum("w")).first()[0]
    o, bins = boosting.Options(), boosting.find_bins(rows, **_BOOST)
    table = boosting.binned(rows, bins, "isFraud", "w", math.log(share / (1 - share)))
    sums = boosting.histograms(table, [], boosting.Tree(), [0], len(bins.names))
    found = boosting.best(boosting.candidates(sums, bins.missing(), len(bins.numeric), o), "feature")
    return _rounded(found.select("feature", "missing_left", F.col("n_l").alias("n_left"), "gain"), "gain")
