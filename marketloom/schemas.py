"""The fixed schemas of panels, products and what backtests return."""

PRICES = "date DATE, product_id BIGINT, sub_type STRING, low DOUBLE, mid DOUBLE, high DOUBLE, market DOUBLE"
PRODUCTS = "product_id BIGINT, group_id BIGINT, name STRING, rarity STRING, kind STRING, released_on DATE"
FILLS = "run_id STRING, day DATE, product_id BIGINT, sub_type STRING, quantity BIGINT, price DOUBLE, fees DOUBLE, impact DOUBLE"
EQUITY = "run_id STRING, date DATE, equity DOUBLE"
ASSET = ["product_id", "sub_type"]
