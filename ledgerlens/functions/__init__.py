"""Column expressions shared by every operator (all JVM-side, no Python UDFs)."""

from ledgerlens.functions.text import (  # noqa: F401
    WS_CLASS, trim_text, text_key, literal_text_key, product_key, canonical_name,
    canonical_names, simple_name,
)
from ledgerlens.functions.numbers import (  # noqa: F401
    MONEY, lenient_number, strict_number, money, money_sum, pct, round6,
)
from ledgerlens.functions.dates import (  # noqa: F401
    parse_dayfirst, parse_iso, month_label, month_start, add_time_features,
)
