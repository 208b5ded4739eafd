"""The views of `tables` as SQL, assembled into a WITH clause on demand."""

from __future__ import annotations

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000
WEEK = 7 * DAY
SECOND = 1_000_000_000

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_DAYNO = "(CAST(l_shipdate AS DATE) - DATE '1970-01-01')"


def _daily(keys: str) -> str:
    return f"""
    SELECT {keys}, day,
      first(price ORDER BY {_KEY}) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY {_KEY}) AS close, sum(l_quantity) AS base_volume,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS quote_volume,
      count(*) AS trade_count, day * {DAY} AS open_time_ns, (day + 1) * {DAY} AS close_time_ns,
      (day + 1) * {DAY} + 1 AS available_time_ns
    FROM trades GROUP BY ALL"""


VIEWS: dict[str, tuple[list[str], str]] = {
    "trades": ([], f"""
    SELECT l.*, p.p_type, p.p_brand, {_DAYNO} AS day, l_extendedprice / l_quantity AS price
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""),
    "decisions": ([], f"""
    SELECT DISTINCT ({_DAYNO} + 1) * {DAY} AS decision_ns FROM lineitem WHERE {_DAYNO} % 7 = 3"""),
    "books": ([], f"""
    SELECT l_orderkey, 'I' || lpad(CAST(l_orderkey % 12 AS VARCHAR), 2, '0') AS instrument_id,
      CASE WHEN l_orderkey % 2 = 0 THEN 'perp' ELSE 'spot' END AS market,
      CASE WHEN l_orderkey % 12 < 6 THEN 1 ELSE 2 END AS tier,
      l_orderkey * {61 * SECOND} AS received_time_ns, price, quantity,
      (CASE WHEN l_orderkey % 29 = 0 THEN 1.5::DOUBLE ELSE 0.999::DOUBLE END)
        * min(price) OVER (PARTITION BY l_orderkey)
        * min(price) OVER (PARTITION BY l_orderkey) / price AS bid_price,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY price) AS lvl,
      count(*) OVER (PARTITION BY l_orderkey) AS n_levels
    FROM (SELECT l_orderkey, l_extendedprice / l_quantity AS price, sum(l_quantity) AS quantity
          FROM lineitem GROUP BY ALL)"""),
    "ticks": ([], f"""
    SELECT event_id, user_id, event_type AS instrument_id, epoch_us(ts) * 1000 AS event_time_ns,
      epoch_us(ts) * 1000 + {SECOND} AS available_time_ns, value AS price,
      CAST(regexp_extract(props, '"k":\\s*([0-9]+)', 1) AS DOUBLE) AS quantity,
      CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side
    FROM events"""),
    "numbered": ([], """
    SELECT user_id AS chain_id, event_id, event_type AS kind, epoch_us(ts) * 1000 AS received_time_ns,
      CAST(CAST(value AS DECIMAL(18,4)) AS VARCHAR) AS payload,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence
    FROM events"""),
    "honest": (["numbered"], """
    SELECT *, sha256(chain_id::VARCHAR || '|' || sequence::VARCHAR || '|' || kind || '|' || payload) AS true_hash
    FROM numbered"""),
    "chain": (["honest"], """
    SELECT chain_id, event_id, kind, received_time_ns, payload, sequence, previous_hash,
      CASE WHEN event_id % 29 = 0 THEN sha256('tampered') ELSE true_hash END AS content_hash
    FROM (SELECT *, coalesce(lag(true_hash) OVER (PARTITION BY chain_id ORDER BY sequence), repeat('0', 64))
            AS previous_hash FROM honest)"""),
    "broken_chain": (["chain"], "SELECT * FROM chain WHERE sequence % 17 <> 0"),
    "hour_bars": (["ticks"], f"""
    SELECT *, open_time_ns + {HOUR} + (trade_count % 3) * {SECOND} AS available_time_ns,
      instrument_id || ':' || open_time_ns AS source_id
    FROM (SELECT instrument_id, event_time_ns // {HOUR} * {HOUR} AS open_time_ns,
      first(price ORDER BY event_time_ns, event_id) AS open, max(price) AS high, min(price) AS low,
      last(price ORDER BY event_time_ns, event_id) AS close, sum(quantity) AS base_volume,
      count(*) AS trade_count FROM ticks GROUP BY ALL)"""),
}

for _short, _column in (("type", "p_type"), ("brand", "p_brand")):
    VIEWS[f"daily_{_short}"] = (["trades"], _daily(f"{_column} AS instrument_id"))
    VIEWS[f"bars_{_short}"] = ([f"daily_{_short}"], f"""
    SELECT *, instrument_id || ':' || min(open_time_ns) OVER (PARTITION BY instrument_id) AS contract_id
    FROM daily_{_short}""")
    VIEWS[f"legs_daily_{_short}"] = (["trades"], _daily(
        f"CASE WHEN l_linenumber % 2 = 1 THEN 'perp' ELSE 'spot' END AS venue, {_column} AS instrument_id"))
    VIEWS[f"legs_{_short}"] = ([f"legs_daily_{_short}"], f"""
    SELECT *, venue || ':' || instrument_id || ':'
      || min(open_time_ns) OVER (PARTITION BY venue, instrument_id) AS contract_id
    FROM legs_daily_{_short}""")
    VIEWS[f"funding_{_short}"] = (["trades"], f"""
    SELECT {_column} AS instrument_id, day * {DAY} + l_linenumber * {3 * HOUR} AS calc_time_ns,
      CAST((CAST(l_discount AS DECIMAL(10,4)) - 0.05) / 100 AS DECIMAL(18,8)) AS rate, {_KEY}
    FROM trades""")


def with_views(*names: str, more: dict[str, str] | None = None) -> str:
    """`WITH a AS (...), b AS (...)` for the named views and all they rest on."""
    ordered: dict[str, str] = {}

    def need(name: str) -> None:
        if name in ordered:
            return
        above, text = VIEWS[name]
        for other in above:
            need(other)
        ordered[name] = text

    for name in names:
        need(name)
    ordered.update(more or {})
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in ordered.items()) + "\n"
