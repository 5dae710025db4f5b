"""Relational smoke queries over the star schema."""

from __future__ import annotations

# round half away from zero of exact cents: sums of integers don't depend on their order
CENTS = "cast(round(l_extendedprice * 100) as bigint) * cast(round((1 - l_discount) * 100) as bigint)"


def pricing_summary(e) -> str:
    return f"select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity, cast(sum({CENTS}) as bigint) as revenue, cast(count(*) as bigint) as lines from {{lineitem}} where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus"


def revenue_by_nation(e) -> str:
    return f"select n.n_name, r.r_name, cast(sum({CENTS}) as bigint) as revenue from {{lineitem}} l join {{orders}} o on l.l_orderkey = o.o_orderkey join {{customer}} c on o.o_custkey = c.c_custkey join {{nation}} n on c.c_nationkey = n.n_nationkey join {{region}} r on n.n_regionkey = r.r_regionkey group by n.n_name, r.r_name"


def top_customers(e) -> str:
    return "select c_custkey, c_name, cents from (select c.c_custkey, c.c_name, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from {customer} c join {orders} o on o.o_custkey = c.c_custkey group by c.c_custkey, c.c_name) t order by cents desc, c_custkey limit 20"


def customers_without_orders(e) -> str:
    return "select c_custkey from {customer} c where not exists (select 1 from {orders} o where o.o_custkey = c.c_custkey)"


def parts_by_brand(e) -> str:
    return "select p_brand, cast(count(distinct l_suppkey) as bigint) as suppliers, cast(count(*) as bigint) as lines from {part} p join {lineitem} l on l.l_partkey = p.p_partkey group by p_brand"


QUERIES = {f.__name__: f for f in (pricing_summary, revenue_by_nation, top_customers, customers_without_orders, parts_by_brand)}
