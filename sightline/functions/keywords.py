"""Name keywords that drive semantic types, column roles and dataset types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists exactly.
IDENTIFIER_NAMES = (
    "locationid", "marketid", "storeid", "customerid", "orderid", "userid",
    "transactionid", "invoiceid", "productid", "employeeid", "accountid",
    "clientid", "vendorid", "supplieid", "rowid", "id",
)
EXPERIMENT = ("promotion", "variant", "treatment", "group", "test", "campaign", "condition", "experiment")
TIME = ("week", "month", "quarter", "year", "day", "date", "period", "time", "timestamp")
TRANSACTIONAL = ("order_id", "transaction_id", "invoice", "receipt", "purchase")
CUSTOMER = ("customer_id", "user_id", "age", "segment", "churn", "ltv", "gender", "region", "tier")
FINANCIAL = ("revenue", "cost", "profit", "margin", "budget", "expense", "sales", "income", "ebitda")
SEGMENT = ("age", "group", "tier", "level", "rank", "score", "grade", "class", "type", "category", "store")
CUSTOMER_LIKE = ("customer", "client", "user")
KPI = (
    "revenue", "sales", "profit", "amount", "total", "count", "price", "cost", "value",
    "quantity", "qty", "income", "loss", "margin", "growth", "rate", "score", "salary",
)
AVERAGED_KPI = ("rate", "score", "margin")
DATE_NAMED = ("date", "time", "year", "month", "day")
DATE_PARSED = ("date", "time", "year", "month")
# End of fixed values.


def contains_any(name: Column, words: tuple[str, ...]) -> Column:
    """True when the lower-case name holds one of the words."""
    return name.rlike("|".join(words))


def name_contains(name: str, words: tuple[str, ...]) -> bool:
    lowered = name.lower()
    return any(w in lowered for w in words)


def normal_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))
