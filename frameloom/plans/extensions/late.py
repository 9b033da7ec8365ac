"""The later half of the hour."""

from pyspark.sql import functions as F

from frameloom.operators.batches import Transforms

STEPS = Transforms()


@STEPS.register("late_minutes", "from minute 30 on")
def late_minutes(rows):
    return rows.where(F.minute("ts") >= 30)
