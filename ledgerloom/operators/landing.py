"""Parsed statements to the ledger: new rows appended, and only the touched accounts reconciled and paired anew."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import references, transaction_hash
from ledgerloom.operators import reconcile, transfers
from ledgerloom.operators.changes import append_new, next_ids
from ledgerloom.session import checkpointed


@dataclass(frozen=True)
class Landed:
    """``inserted``: the new transactions. ``files``: file, account_id (null: no account for the bank), parsed, inserted, skipped.

    ``reconciled``: the balance walk of the touched accounts. ``transfers``: pairs with a leg in one of them.
    """

    inserted: DataFrame
    files: DataFrame
    reconciled: DataFrame
    transfers: DataFrame


def land(parsed: DataFrame, accounts: DataFrame, transactions: DataFrame, keywords: DataFrame, locked: DataFrame) -> Landed:
    """``parsed``: file, bank, statement_seq, txn_date, amount_paise, narration, bank_balance_paise (of any statement source).

    A bank's rows go to its account (its last, if it has several). A row that is known by account, date, amount and
    narration, or stands twice in what lands, is skipped; each file with new rows
    becomes a statement. Of other accounts only rows are read that could be a leg of a touched account's:
    the same absolute amount, or a shared reference.
    """
    owner = accounts.groupBy("bank").agg(F.max("id").alias("account_id"))
    rows = parsed.join(owner, "bank", "left")
    none = F.lit(None).cast("string")
    identity = transaction_hash(F.col("account_id"), F.col("txn_date"), none, F.col("amount_paise"), F.col("narration"))
    rows = checkpointed(rows.withColumn("import_hash", identity))
    touched = checkpointed(rows.where("account_id is not null").select("account_id").distinct())
    known = transactions.join(touched, "account_id", "left_semi").select(identity.alias("import_hash"))
    fresh = checkpointed(append_new(known, rows.where("account_id is not null"), "import_hash", [F.col("file"), F.col("statement_seq")]))
    statements = next_ids(transactions.select("statement_id"), fresh.select("file").distinct(), [F.col("file")], id_col="statement_id")
    fresh = fresh.join(statements, "file").withColumn("type", F.lit("regular"))
    made = next_ids(transactions.select("id"), fresh, [F.col("file"), F.col("statement_seq")])
    types = dict(transactions.dtypes)
    inserted = checkpointed(made.select(*((F.col(c) if c in made.columns else F.lit(None)).cast(types[c]).alias(c) for c in transactions.columns)))

    came = made.groupBy("file").agg(F.count("*").alias("inserted"))
    files = rows.groupBy("file").agg(F.max("account_id").alias("account_id"), F.count("*").alias("parsed")).join(came, "file", "left").fillna(0, ["inserted"])
    files = files.withColumn("skipped", F.when(F.col("account_id").isNotNull(), F.col("parsed") - F.col("inserted")).otherwise(0))

    now = transactions.unionByName(inserted)
    own = now.join(touched, "account_id", "left_semi").select(*now.columns)
    sizes = own.select(F.abs("amount_paise").alias("size")).distinct()
    same_size = now.withColumn("size", F.abs("amount_paise")).join(sizes, "size", "left_semi").select(*now.columns)
    quoted = same_size.select(F.explode(references(F.col("narration"))).alias("reference")).distinct()
    quoting = now.select("id", F.explode(references(F.col("narration"))).alias("reference")).join(quoted, "reference", "left_semi").select("id")
    scope = same_size.unionByName(now.join(quoting.distinct(), "id", "left_semi").select(*now.columns)).dropDuplicates(["id"])
    pairs = checkpointed(transfers.detect(checkpointed(scope), keywords, locked))
    leg = lambda c: own.select(F.col("id").alias(c))
    ours = pairs.join(leg("debit_id"), "debit_id", "left_semi").unionByName(pairs.join(leg("debit_id"), "debit_id", "left_anti").join(leg("credit_id"), "credit_id", "left_semi").select(*pairs.columns))
    return Landed(inserted, files, reconcile.reconcile(own), ours)


def each_batch(accounts: DataFrame, ledger: Callable[[], DataFrame], keywords: DataFrame, locked: Callable[[], DataFrame], write: Callable[[Landed, int], None]) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` takes for a stream of parsed rows: each batch lands on the ledger as it then is.

    A batch that runs again finds its rows known and inserts nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write(land(batch, accounts, ledger(), keywords, locked()), batch_id)

    return run
