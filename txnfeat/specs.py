"""Names, schemas and roles of both datasets: the ledger (hourly steps, no order within one) and the card (seconds and a unique id)."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of the input and output contracts.
LEDGER_REQUIRED = ("step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig", "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud")
CARD_REQUIRED = ("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", "card1")
LEDGER_OUTPUT_REQUIRED = ("txn_id", "step", "nameOrig", "nameDest", "isFraud", "split", "amount", "amount_log1p", "step_hour", "hour_sin", "hour_cos", "dest_prior_txn_count", "dest_first_seen_flag", "feature_version")
CARD_OUTPUT_REQUIRED = ("TransactionID", "isFraud", "TransactionDT", "split", "card_proxy_id", "hour_of_day", "hour_sin", "hour_cos", "amt_log1p", "card_prior_txn_count", "card_first_seen_flag", "feature_version")
LEDGER_TYPES = ("TRANSFER", "CASH_OUT", "PAYMENT", "CASH_IN", "DEBIT")
TIER_B = ("newbalanceOrig", "newbalanceDest", "err_balance_orig", "err_balance_dest", "orig_new_balance_zero_flag")
LEDGER_RAW = T.StructType([T.StructField(n, t, True) for n, t in (
    ("step", T.IntegerType()), ("type", T.StringType()), ("amount", T.DoubleType()), ("nameOrig", T.StringType()),
    ("oldbalanceOrg", T.DoubleType()), ("newbalanceOrig", T.DoubleType()), ("nameDest", T.StringType()),
    ("oldbalanceDest", T.DoubleType()), ("newbalanceDest", T.DoubleType()), ("isFraud", T.IntegerType()), ("isFlaggedFraud", T.IntegerType()),
)])

# The card's column families, by rule.
IDENTITY = (*(f"id_{i:02d}" for i in range(1, 39)), "DeviceType", "DeviceInfo")
M_COLUMNS = tuple(f"M{i}" for i in range(1, 10))
C_COLUMNS = tuple(f"C{i}" for i in range(1, 15))
D_COLUMNS = tuple(f"D{i}" for i in (*range(1, 8), *range(10, 16)))
# Indicator suffix and source column of each block of columns that are missing together.
INDICATORS = {"addr": "addr1", "dist1": "dist1", "dist2": "dist2", "Pemail": "P_emaildomain", "Remail": "R_emaildomain", **{f"D{i}": f"D{i}" for i in (2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14, 15)}, "M1_3": "M1", "V1_11": "V1", "V12_34": "V12", "V35_52": "V35", "V53_74": "V53", "V75_94": "V75", "V138_166": "V138", "V167_278": "V167", "V322_339": "V322"}
# Near-constant card columns.
NEAR_CONSTANT = ("V1", "V14", "V27", "V28", "V41", "V65", "V68", "V88", "V89", "V107", "V240", "V241", "V305", "id_27")
CARD_STRINGS = frozenset(("ProductCD", "card4", "card6", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo", *M_COLUMNS, *(f"id_{i}" for i in (12, 15, 16, 23, *range(27, 32), *range(33, 39)))))
CARD_INTS = frozenset(("TransactionID", "isFraud", "TransactionDT", "card1"))


def card_columns() -> tuple[str, ...]:
    """The card's 434 raw columns in order."""
    return ("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", *(f"card{i}" for i in range(1, 7)), "addr1", "addr2", "dist1", "dist2", "P_emaildomain", "R_emaildomain", *C_COLUMNS, *(f"D{i}" for i in range(1, 16)), *M_COLUMNS, *(f"V{i}" for i in range(1, 340)), *IDENTITY)


def card_raw_schema() -> T.StructType:
    kind = lambda c: T.IntegerType() if c in CARD_INTS else T.StringType() if c in CARD_STRINGS else T.DoubleType()
    return T.StructType([T.StructField(c, kind(c), True) for c in card_columns()])


# The ledger's features at authorisation time, in the order of the feature matrix.
TIER_A = ("amount", "oldbalanceOrg", "oldbalanceDest", "step_hour", "hour_sin", "hour_cos", "type_transfer", "type_cash_out", "type_payment", "type_cash_in", "type_debit", "amount_log1p", "amount_zero_flag", "amt_to_oldbalOrg", "amt_to_oldbalDest", "orig_drain_flag", "amount_exceeds_orig_balance_flag", "orig_balance_zero_flag", "dest_balance_zero_flag", "dest_prior_txn_count", "dest_first_seen_flag", "dest_prior_amount_sum", "dest_prior_amount_mean", "dest_prior_amount_std", "dest_prior_amount_max", "dest_steps_since_last_txn", "dest_amount_zscore", "dest_txn_count_prev_24h", "dest_txn_count_prev_168h", "dest_amount_sum_prev_24h", "dest_amount_sum_prev_168h", "dest_prior_cashout_share")
TIER_AB = (*TIER_A, *TIER_B)


def card_features() -> tuple[str, ...]:
    """The card's feature matrix: all raw and derived columns but keys, clock, label, split and version."""
    raw = [c for c in card_columns() if c not in ("TransactionID", "isFraud", "TransactionDT") and c not in NEAR_CONSTANT]
    derived = ["identity_nonnull_count", "has_identity_flag", "identity_completeness", *(f"ind_{s}" for s in INDICATORS), "hour_of_day", "hour_sin", "hour_cos", "day_of_week_rel", "history_window_complete_flag", "amt_log1p", "amt_cents", "amt_decimals_gt2_flag", "amt_is_whole_flag", "m_true_cnt", "m_false_cnt", "m_null_cnt", "c_sum_log1p", "c_nonzero_cnt", "c_max", "d_nonnull_cnt", "d_min", "d_max", "card_prior_txn_count", "card_first_seen_flag", "card_prior_amt_sum", "card_prior_amt_mean", "card_prior_amt_std", "card_prior_amt_max", "amt_zscore_vs_card", "card_secs_since_last_txn", "card_txn_count_1h", "card_txn_count_24h", "card_txn_count_7d"]
    return (*raw, *derived)
