"""The fixture views as SQL (DuckDB dialect), for the independent oracle.

These mirror ``ordercraft.sources.fixtures`` and ``FIXTURES.md``. Oracle
queries are composed as ``WITH <views> <body>`` because only the base tables
exist in the oracle's database.
"""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "sales": ((), """
select l.l_orderkey as transaction_id, o.o_orderdate as transaction_date,
 'Cust' as customer_first_name, c.c_name as customer_last_name, n.n_name as customer_state,
 cast(100 + c.c_nationkey as varchar) as customer_postal_code,
 concat('u', cast(c.c_custkey as varchar), '@example.com') as customer_email,
 'Ship' as shipping_first_name,
 case when o.o_orderkey % 9 = 0 then 'Gift Desk' else c.c_name end as shipping_last_name,
 cast(200 + c.c_nationkey as varchar) as shipping_postal_code,
 concat('555-', cast(c.c_custkey as varchar)) as customer_phone,
 concat(cast(o.o_orderkey % 100 as varchar), ' Main St') as shipping_address1,
 concat('City ', cast(c.c_nationkey as varchar)) as shipping_city, n.n_name as shipping_state,
 concat('556-', cast(c.c_custkey as varchar)) as shipping_phone,
 concat('PC', cast(p.p_partkey as varchar)) as product_code,
 p.p_name as product_name, p.p_brand as product_options, p.p_partkey as item_code,
 cast(p.p_retailprice as decimal(18,2)) as product_price, p.p_size as product_weight,
 cast(l.l_quantity as int) as product_quantity,
 case o.o_orderkey % 3 when 0 then 0 when 1 then 5 else 10 end as shipping_total,
 case when o.o_orderkey % 4 = 0 then -10 else 0 end as discount_total,
 cast(o.o_totalprice as decimal(18,2)) as order_total,
 case when o.o_orderkey % 5 = 0 then concat('SAVE10:', o.o_orderpriority) else '-' end as coupons_used,
 row_number() over (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey,
   l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_shipdate, l.l_returnflag,
   l.l_linestatus) as line_seq
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
 join customer c on o.o_custkey = c.c_custkey
 join nation n on c.c_nationkey = n.n_nationkey
 join part p on l.l_partkey = p.p_partkey"""),
    "raw_sales": (("sales",), """
select transaction_id, line_seq,
 case when line_seq = 1 then transaction_date end as transaction_date,
 case when line_seq = 1 then customer_last_name end as customer_last_name,
 case when line_seq = 1 then customer_state end as customer_state,
 case when line_seq = 1 then shipping_total end as shipping_total,
 case when line_seq = 1 then discount_total end as discount_total,
 case when line_seq = 1 then order_total end as order_total,
 product_name, product_options, product_price, product_weight, product_quantity
from sales"""),
    "raw_pulls": (("raw_sales",), """
select 1 as pull, r.* from raw_sales r
union all select 2 as pull, r.* from raw_sales r where transaction_id % 10 = 0"""),
    "pricing": ((), """
select p_name as product_name, p_brand as product_options,
 cast(p_retailprice as decimal(18,2)) as product_price, p_size as product_weight,
 concat(p_type, ' ', p_name) as product_normalized,
 case when p_partkey % 10 = 0 then null else cast(p_retailprice * 0.5 as decimal(18,2)) end as distributor_price,
 p_partkey % 6 + 1 as units_normalized
from part"""),
    "ship_log": ((), """
select o_orderkey as order_no, cast(o_totalprice / 10000 as decimal(18,2)) as actual_freight_expense
from orders where o_orderkey % 7 <> 0"""),
    "fedex": ((), """
select case when l.l_linenumber = 7 then null when l.l_linenumber = 6 then 'Non Zone'
   else cast(l.l_suppkey % 7 + 2 as varchar) end as pricing_zone,
 n.n_name as recipient_state,
 concat(cast(l.l_orderkey as varchar), '-', cast(l.l_linenumber as varchar)) as tracking_no,
 l.l_shipdate as date_shipment, l.l_shipdate + interval 3 day as date_delivery,
 last_day(l.l_shipdate) as date_invoice
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
 join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey"""),
    "inventory": ((), """
select case when p.p_size % 10 = 0 then '-' else p.p_brand end as packaging,
 case when p.p_size % 3 = 0 then '-' else p.p_type end as packaging_retail,
 case when p.p_partkey % 2 = 0 then 'packaging' else 'product' end as type,
 p.p_partkey % 20 as item_code, last_day(l.l_shipdate) as date, l.l_quantity as inventory_count
from lineitem l join part p on l.l_partkey = p.p_partkey"""),
    "production": ((), """
select case when p.p_size % 10 = 0 then '-' else p.p_brand end as packaging,
 case when p.p_size % 3 = 0 then '-' else p.p_type end as packaging_retail, p.p_name as product,
 concat(case l.l_returnflag when 'A' then 'A' when 'R' then 'PR' else 'P0' end, cast(p.p_partkey as varchar)) as product_num,
 case l.l_linestatus when 'O' then 'II' else 'IR' end as transfer_code,
 l.l_quantity as transaction_units, l.l_shipdate as date_transaction, o.o_orderdate as date_production
from lineitem l join part p on l.l_partkey = p.p_partkey join orders o on l.l_orderkey = o.o_orderkey"""),
}


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(views: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` the named fixture views (plus ``extra`` (name, sql) CTEs) around ``body``."""
    ctes = [f"{n} AS ({VIEWS[n][1].strip()})" for n in _closure(views)]
    ctes += [f"{n} AS ({sql.strip()})" for n, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
