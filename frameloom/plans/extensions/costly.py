"""Purchases and what they cost."""

from frameloom.operators.batches import Transforms

STEPS = Transforms()


@STEPS.register("purchases", "purchases only")
def purchases(rows):
    return rows.where("event_type = 'purchase'")


@STEPS.register("costly", "values above 100")
def costly(rows):
    return rows.where("value > 100")
