"""Rows that several tests share, made from the rules that they test: ties, window ends, zeros and drained accounts."""

from txnfeat.specs import LEDGER_TYPES, card_raw_schema

LEDGER_COLUMNS = "step int, type string, amount double, nameOrig string, oldbalanceOrg double, newbalanceOrig double, nameDest string, oldbalanceDest double, newbalanceDest double, isFraud int"


def _ledger_row(i):
    """Three rows in each third step, two of them to one account; every third payer is drained, every ninth amount is zero."""
    amount = 0.0 if i % 9 == 5 else 10.0 * (i * i % 11 + 1)
    before, dest = amount * (i % 3), 50.0 * (i % 4)
    return 3 * (i % 7) + 1, LEDGER_TYPES[i % 5], amount, f"payer{i}", before, max(before - amount, 0.0), f"shop{i % 2}", dest, dest + amount, int(i % 6 == 1)


LEDGER = [_ledger_row(i) for i in range(21)]
WINDOWS = (3600, 86400, 604800)
LAST = 2_000_000
# A tie of three in one second, a row on each window's end and one just outside, and a row seven seconds before the last.
_CLOCKS = [150_000] * 3 + [LAST - w - out for w in WINDOWS[::-1] for out in (1, 0)] + [LAST - 7, LAST]
BOUNDARY = [(clock, 501 + i, 20.0 + 3 * i) for i, clock in enumerate(_CLOCKS)]


def small_card_schema():
    from pyspark.sql.types import StructType

    keep = ("TransactionID", "isFraud", "TransactionDT", "TransactionAmt", "ProductCD", *(f"card{i}" for i in range(1, 7)), "addr1", "M1", "C1", "D1")
    return StructType([f for f in card_raw_schema() if f.name in keep])


def boundary_rows():
    return [(i, 0, clock, a, "H", 777, 321.0, 120.0, "mastercard", 102.0, "credit", None, None, None, None) for clock, i, a in BOUNDARY]
