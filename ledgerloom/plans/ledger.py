"""The ledger that the sync queries start from."""

import uuid

from pyspark.sql import functions as F

from ledgerloom import workspace
from ledgerloom.operators import mutations, windows
from ledgerloom.plans.registry import AS_OF_TXN, LEDGER_UNTIL
from ledgerloom.schemas import moment
from ledgerloom.sinks import ledger


def stored_ledger(s, orders):
    """A ledger in buckets that holds, once each, the ``orders`` from before ``LEDGER_UNTIL``.

    ``orders`` are read from columns, not from payloads, which the sync alone parses.
    """
    name, buckets = f"ledger_{uuid.uuid4().hex}", int(s.spark.conf.get("spark.sql.shuffle.partitions"))
    ledger.register(s.spark, name, workspace.new_folder(s.spark, "ledger"), buckets)
    earlier = windows.first_orders(orders.where(F.col("created_at") < moment(LEDGER_UNTIL)))
    return ledger.append(mutations.sale_rows(earlier), name, AS_OF_TXN, buckets)
