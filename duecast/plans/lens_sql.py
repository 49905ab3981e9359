"""The domain views of ``duecast.sources.lenses`` as SQL, for the checks."""

INVOICES = """invoices AS (
  SELECT o_orderkey AS row_id, o_custkey AS cust_number, CAST(o_orderdate AS DATE) AS posting_date,
         CAST(o_orderdate AS DATE) + 30 AS due_date,
         CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7919) % 61 AS INTEGER) END AS clear_date,
         o_totalprice AS total_open_amount, o_orderpriority AS business_code, o_orderstatus AS document_type
  FROM orders)"""

DEMAND = """demand AS (
  SELECT CAST(l_shipdate AS DATE) AS date, r_name AS store_id, p_type AS product_id,
         sum(l_quantity) AS units_sold, sum(l_extendedprice) / sum(l_quantity) AS price,
         sum(l_extendedprice * l_discount) AS discount_amount,
         CAST((date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 37 + length(p_type) * 11) % 180 AS DOUBLE) AS inventory_level
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY CAST(l_shipdate AS DATE), r_name, p_type)"""


def _month(position: int, pay: int) -> str:
    here = f"max(CASE WHEN n = {position} THEN"
    return (
        f"{here} CAST((o_orderkey * 17) % 8 - 2 AS INTEGER) END) AS PAY_{pay}, "
        f"{here} o_totalprice END) AS BILL_AMT{position}, "
        f"{here} o_totalprice * ((o_orderkey * 31) % 100) / 100 END) AS PAY_AMT{position}"
    )


_MONTHS = ", ".join(_month(i, p) for i, p in enumerate((0, 2, 3, 4, 5, 6), start=1))

CREDIT = f"""credit AS (
  SELECT c_custkey, c_name AS client_id, c_acctbal * 50 AS LIMIT_BAL, CAST(18 + c_custkey % 70 AS INTEGER) AS AGE,
         CAST(c_custkey % 7 AS INTEGER) AS EDUCATION, CAST(c_custkey % 4 AS INTEGER) AS MARRIAGE, c_mktsegment AS segment,
         h.* EXCLUDE (o_custkey),
         CASE WHEN PAY_0 IS NOT NULL THEN CASE WHEN PAY_0 > 1 THEN 1 ELSE 0 END END AS default_next_month
  FROM customer LEFT JOIN (
    SELECT o_custkey, {_MONTHS}
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    WHERE n <= 6 GROUP BY o_custkey) h ON c_custkey = o_custkey)"""

PAY_STATUS = [f"PAY_{i}" for i in (0, 2, 3, 4, 5, 6)]
BILLS = [f"BILL_AMT{i}" for i in range(1, 7)]
PAYMENTS = [f"PAY_AMT{i}" for i in range(1, 7)]


def _text(column: str) -> str:
    if column.startswith(("BILL_", "PAY_AMT", "LIMIT")):
        return f"CAST(CAST(round({column}) AS BIGINT) AS VARCHAR)"
    return f"CAST({column} AS VARCHAR)"


_PLAIN = [c for c in ["LIMIT_BAL", "MARRIAGE", *PAY_STATUS[1:], *BILLS, *PAYMENTS] if c != "BILL_AMT2"]

CREDIT_TEXT = f"""{CREDIT}, credit_text AS (
  SELECT c_custkey, segment, c_custkey + 2 AS source_row_number,
         CASE WHEN c_custkey % 97 = 0 THEN ' ' WHEN c_custkey % 89 = 0 THEN 'Customer#000000001' ELSE client_id END AS client_id,
         CASE WHEN c_custkey % 53 = 0 THEN 'abc' WHEN c_custkey % 61 = 0 THEN '175' ELSE {_text('AGE')} END AS AGE,
         CASE WHEN c_custkey % 71 = 0 THEN '' ELSE {_text('EDUCATION')} END AS EDUCATION,
         CASE WHEN c_custkey % 67 = 0 THEN '9' ELSE {_text('PAY_0')} END AS PAY_0,
         CASE WHEN c_custkey % 59 = 0 THEN '-' || {_text('BILL_AMT2')} ELSE {_text('BILL_AMT2')} END AS BILL_AMT2,
         CASE WHEN c_custkey % 83 = 0 THEN '2' ELSE {_text('default_next_month')} END AS default_next_month,
         {', '.join(f'{_text(c)} AS {c}' for c in _PLAIN)}
  FROM credit)"""

DEMAND_TEXT = """demand_text AS (
  SELECT k AS row_id,
         CASE WHEN k % 101 = 0 THEN 'invalid' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date,
         CASE WHEN k % 103 = 0 THEN ' ' ELSE CAST(l_suppkey % 10 AS VARCHAR) END AS store_id,
         CAST(l_partkey % 20 AS VARCHAR) AS product_id,
         CASE WHEN k % 107 = 0 THEN '-1' WHEN k % 109 = 0 THEN 'n/a' ELSE CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) END AS units_sold,
         CASE WHEN k % 113 = 0 THEN NULL ELSE CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS VARCHAR) END AS inventory_level,
         l_extendedprice AS amount
  FROM (SELECT *, l_orderkey * 8 + l_linenumber AS k FROM lineitem))"""

CASH = """cash AS (
  SELECT user_id AS entity, CAST(ts AS DATE) AS period,
         sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END) AS cash_inflow,
         sum(CASE WHEN event_type = 'error' THEN value ELSE 0.0 END) AS cash_outflow
  FROM events GROUP BY 1, 2)"""

SCORES = """scores AS (
  SELECT row_id, client_id, segment, company_id, status_code, amount, t / 1000.0::DOUBLE AS p,
         CASE WHEN (row_id * 7919) % 1000 < t THEN 1 ELSE 0 END AS y
  FROM (SELECT o_orderkey AS row_id, o_custkey AS client_id, o_orderpriority AS segment,
               CAST(o_orderkey % 5 AS VARCHAR) AS company_id, o_orderstatus AS status_code, o_totalprice AS amount,
               ((o_orderkey % 1000003) * 2654435761) % 1000 AS t FROM orders))"""

FORECASTS = f"""{DEMAND}, forecasts AS (
  SELECT date, store_id, product_id, units_sold, inventory_level, price,
         round(units_sold * (0.7::DOUBLE + (isodow(date) - 1) / 10.0::DOUBLE) + 3, 2) AS forecast_value FROM demand)"""

ACCEPTED_LOANS = """accepted_loans AS (
  SELECT k AS row_id, CAST(k // 2 AS VARCHAR) AS id,
         CAST(CAST(trunc(c_acctbal) AS BIGINT) * 21 + 20000 AS VARCHAR) AS annual_inc,
         CAST(CAST(trunc(o_totalprice) AS BIGINT) % 40 + 1 AS VARCHAR) || ',000' AS loan_amnt,
         CASE WHEN k % 11 > 0 THEN CAST(600 + k % 200 AS VARCHAR) END AS fico_range_low,
         CAST(604 + k % 200 AS VARCHAR) AS fico_range_high,
         CASE WHEN k % 13 = 0 THEN 'n/a' WHEN k % 13 = 12 THEN '< 1 year' ELSE CAST(k % 13 AS VARCHAR) || '+ years' END AS emp_length,
         CAST(k % 40 AS VARCHAR) AS total_acc, CAST(k % 25 AS VARCHAR) || '.5%' AS int_rate,
         CASE WHEN k % 2 = 0 THEN ' 36 months' ELSE ' 60 months' END AS term, CASE WHEN k % 29 > 0 THEN CAST(k % 35 AS VARCHAR) END AS dti,
         CASE WHEN k % 3 = 0 THEN 'MORTGAGE' WHEN k % 3 = 1 THEN 'mortgage' ELSE 'RENT' END AS home_ownership,
         c_mktsegment AS purpose, CASE WHEN k % 10 = 0 THEN 'Joint App' ELSE 'Individual' END AS application_type,
         CASE o_orderstatus WHEN 'F' THEN 'Fully Paid' WHEN 'P' THEN ' Charged Off ' ELSE 'Current' END AS loan_status
  FROM (SELECT *, o_orderkey AS k FROM orders) JOIN customer ON o_custkey = c_custkey)"""
