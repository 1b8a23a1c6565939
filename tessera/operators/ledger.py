"""Payments, grants and subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_status(order_status: Column, received: Column, due: Column, incoming: Column) -> Column:
    """Status of a transaction against its order (null status: no order found). An expired order may still be paid."""
    return (
        F.when(~incoming, "ignored")
        .when(order_status.isNull(), "unmatched")
        .when(order_status.isin("paid", "cancelled", "refunded", "failed"), "late")
        .when(received < due, "underpaid")
        .otherwise("matched")
    )


def subscription_state(starts: Column, expires: Column, revoked: Column, now: Column) -> Column:
    return F.when(revoked, "revoked").when(expires <= now, "expired").when(starts > now, "scheduled").otherwise("active")


def remaining_attempts(grants: DataFrame, owner: str, left: str) -> DataFrame:
    """Sum of what the grants leave; one unlimited grant (null) makes the owner unlimited (null)."""
    return grants.groupBy(owner).agg(F.when(F.bool_or(F.col(left).isNull()), None).otherwise(F.sum(left)).alias("remaining"))


def effective_price(promo: Column, listed: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(promo, F.lit(0)), F.nullif(listed, F.lit(0)), default)


def fold_states(events: DataFrame, key: str, order: list[str], kind: str, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    """Final state per key after its events in order; a pair without a move keeps the state. One fold a key."""
    table = F.create_map(*[F.lit(x) for (s, e), to in moves.items() for x in (f"{s}|{e}", to)])
    lists = events.where(F.col(kind).isin(sorted({e for _, e in moves}))).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(kind).alias("e")))).alias("es"))
    step = lambda s, x: F.coalesce(F.try_element_at(table, F.concat_ws("|", s, x["e"])), s)
    moved = lists.select(key, F.aggregate("es", F.lit(start), step).alias("state"))
    return events.select(key).distinct().join(moved, key, "left").select(key, F.coalesce("state", F.lit(start)).alias("state"))


TRANSACTION = "struct<txn_id: string, amount: bigint, content: string, occurred: string, incoming: boolean>"


def webhook_transactions(payload: Column, kind: Column) -> Column:
    """array<struct<txn_id, amount, content, occurred, incoming>> of a webhook's JSON payload, by the kind of its sender.

    "transfer": one object whose type tells the direction; "list": ``data`` holds one object or a list, and the sign of an
    amount its direction; "signed": one object, always incoming. Any other kind, and a payload that is no JSON, give none.
    """
    text = lambda path: F.get_json_object(payload, path)
    whole = lambda c: F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))
    made = lambda i, amount, content, at, incoming: F.struct(i.alias("txn_id"), amount.alias("amount"), content.alias("content"), at.alias("occurred"), incoming.alias("incoming")).cast(TRANSACTION)
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    data = text("$.data")
    rows = F.from_json(F.when(data.rlike(r"^\s*\["), data).otherwise(F.concat(F.lit("["), data, F.lit("]"))), "array<struct<tid: string, id: string, amount: string, description: string, when: string, transactionDateTime: string>>")
    listed = F.transform(rows, lambda r: made(F.coalesce(F.nullif(r["tid"], F.lit("")), r["id"]), F.abs(whole(r["amount"])), or_empty(r["description"]), F.coalesce(r["when"], r["transactionDateTime"]), whole(r["amount"]) > 0))
    transfer = made(text("$.id"), whole(text("$.transferAmount")), F.concat_ws(" ", or_empty(text("$.content")), or_empty(text("$.description"))), text("$.transactionDate"), F.coalesce(text("$.transferType"), F.lit("in")) == "in")
    signed = made(text("$.txn_id"), whole(text("$.amount")), or_empty(text("$.content")), text("$.occurred_at"), F.lit(True))
    none = F.array().cast(f"array<{TRANSACTION}>")
    return F.coalesce(F.when(text("$").isNull(), none).when(kind == "transfer", F.array(transfer)).when(kind == "list", listed).when(kind == "signed", F.array(signed)), none)
