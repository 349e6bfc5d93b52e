"""What kinds of documents and relationships there are, and what follows from a kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: For each type of document, the business domain and the link of the payment chain that it is evidence for.
DOCUMENT_TYPES: dict[str, tuple[str, str]] = {
    "contract": ("legal", "contract"),
    "bill_of_quantities": ("procurement", "boq"),
    "schedule_of_rates": ("procurement", "reference"),
    "purchase_order": ("procurement", "material"),
    "measurement_book": ("engineering", "measurement"),
    "running_bill": ("financial", "ra_bill"),
    "invoice": ("financial", "ra_bill"),
    "delivery_challan": ("procurement", "material"),
    "goods_receipt_note": ("procurement", "material"),
    "material_test_certificate": ("material", "quality"),
    "inspection_report": ("engineering", "quality"),
    "change_order": ("legal", "variation"),
    "model_agreement": ("legal", "reference"),
    "audit_report": ("financial", "reference"),
    "tender_notice": ("procurement", "contract"),
    "technical_specification": ("engineering", "reference"),
    "award_notice": ("procurement", "contract"),
    "corrigendum": ("procurement", "contract"),
    "bid_document": ("procurement", "contract"),
    "drawing": ("engineering", "other"),
    "payment_certificate": ("financial", "ra_bill"),
    "bank_guarantee": ("financial", "other"),
    "unknown": ("unknown", "other"),
}
#: Roles that a document may have in a project; a type of the same name gives the role.
ROLES = (
    "tender_notice", "bid_document", "contract", "bill_of_quantities", "measurement_book", "running_bill", "invoice", "payment_certificate",
    "inspection_report", "completion_certificate", "corrigendum", "unclassified",
)
#: Relationships with a name for the other direction; all others are their own.
INVERSES = {"parent_document": "child_document", "child_document": "parent_document"}
#: Types that quote figures of other projects, and formats that have a reader.
REFERENCE_TYPES = ("technical_specification", "schedule_of_rates", "model_agreement", "audit_report")
READABLE = ("pdf", "xlsx")


def looked_up(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def category(kind: Column) -> Column:
    """The business domain of a type; null for a type that there is not."""
    return looked_up(kind, {k: c for k, (c, _) in DOCUMENT_TYPES.items()})


def workflow(kind: Column) -> Column:
    return looked_up(kind, {k: w for k, (_, w) in DOCUMENT_TYPES.items()})


def role(declared: Column) -> Column:
    return F.when(declared.isin(*ROLES), declared).otherwise("unclassified")


def inverse(relationship: Column) -> Column:
    return F.coalesce(looked_up(relationship, INVERSES), relationship)


def suppressed(kind: Column, nit_number: Column) -> Column:
    """A reference document's own figures are left out, unless it says which tender it is about."""
    return kind.isin(*REFERENCE_TYPES) & nit_number.isNull()


def unreadable(file_format: Column) -> Column:
    return ~F.coalesce(file_format.isin(*READABLE), F.lit(False))


def disputed(declared: Column, suggested: Column) -> Column:
    """A suggestion that differs from what was declared; without a suggestion there is no dispute."""
    return F.coalesce(suggested != declared, F.lit(False))


def status(state: Column, file_format: Column, needs_attention: Column) -> Column:
    """What is shown of a document, from its state, whether its format has a reader, and whether a finding is open."""
    return (
        F.when(state == "failed", "failed").when(state == "quarantined", "needs_attention").when(unreadable(file_format), "unsupported")
        .when(state == "processing", "processing").when((state == "processed") & needs_attention, "needs_attention").when(state == "processed", "processed").otherwise("uploaded")
    )
