"""Columns of ledgers, accounts and their CSV files."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()

#: The ledger contract: every plan reads these columns, whatever the source.
LEDGER = _struct(
    ts=T.TimestampNTZType(), from_bank=_L, from_account=_S, to_bank=_L, to_account=_S, amount_received=_D,
    receiving_currency=_S, amount_paid=_D, payment_currency=_S, payment_format=_S,
)
ACCOUNTS = _struct(bank_name=_S, bank_id=_L, account_number=_S, entity_id=_S, entity_name=_S)

#: CSV files are read by position: a transaction file's header names Account twice. The label is dropped.
LEDGER_CSV = _struct(
    ts_text=_S, from_bank=_L, from_account=_S, to_bank=_L, to_account=_S, amount_received=_D,
    receiving_currency=_S, amount_paid=_D, payment_currency=_S, payment_format=_S, is_laundering=T.IntegerType(),
)
EDGE = ("src_bank", "src_account", "dst_bank", "dst_account")
