"""Explicit schemas; nothing is inferred at run time."""

from pyspark.sql import types as T

_S, _D, _L, _B, _I = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RESPONSE_PRODUCT = _struct(
    id=_S,
    product_id=_S,
    name=_S,
    type=_S,
    category=T.ArrayType(_S),
    softCategory=T.ArrayType(_S),
    price=_D,
    stockStatus=_S,
    stock_status=_S,
    highTextMatch=_B,
    exactMatchBonus=_D,
    textMatchBonus=_D,
)
RESPONSE_TIERS = _struct(highTextMatches=_D)
RESPONSE_METADATA = _struct(isComplex=_B, tiers=RESPONSE_TIERS)
RESPONSE_OBJECT = _struct(
    products=T.ArrayType(RESPONSE_PRODUCT),
    results=T.ArrayType(RESPONSE_PRODUCT),
    metadata=RESPONSE_METADATA,
)
RESPONSE_ARRAY = T.ArrayType(RESPONSE_PRODUCT)

ORDER_CUSTOMER = _struct(id=_L, email=_S, first_name=_S, last_name=_S, phone=_S)
ORDER_LINE = _struct(
    product_id=_L, variant_id=_L, title=_S, variant_title=_S, quantity=_L, price=_S, sku=_S, vendor=_S
)
ORDER_WEBHOOK = _struct(
    id=_L,
    name=_S,
    created_at=T.TimestampType(),
    currency=_S,
    total_price=_S,
    subtotal_price=_S,
    total_tax=_S,
    customer=ORDER_CUSTOMER,
    line_items=T.ArrayType(ORDER_LINE),
    note_attributes=T.ArrayType(_struct(name=_S, value=_S)),
)

TIME_WINDOW = _struct(timezone=_S, startHour=_I, endHour=_I)
TARGETING = _struct(mode=_S, patterns=T.ArrayType(_S), matchType=_S, timeWindow=TIME_WINDOW)
PIN = _struct(query=_S, productIds=T.ArrayType(_S), enabled=_B)
ASSOCIATION = _struct(softCategories=T.ArrayType(_S), categories=T.ArrayType(_S), limit=_I)
PATCH = _struct(
    softCategoriesBoost=T.MapType(_S, _D),
    pinnedResults=T.ArrayType(PIN),
    productBoosts=T.MapType(_S, _D),
    profileBoostMultiplier=_D,
    categoryAssociation=ASSOCIATION,
)
ARM = _struct(key=_S, weight=_D, patch=PATCH)
EXPERIMENTS = T.ArrayType(_struct(id=_S, trafficPct=_D, arms=T.ArrayType(ARM), targeting=TARGETING))
RULES = T.ArrayType(_struct(id=_S, condition=TARGETING, patch=PATCH))
