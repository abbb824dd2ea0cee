"""The registered queries as DuckDB SQL over the same tables, written apart from the Spark code."""

from __future__ import annotations

from ductwise.functions import reference as ref

SQL: dict[str, str] = {}

_DN = "case " + " ".join(f"when {{0}} <= {c} + 1e-9 then {dn}" for dn, c, *_ in ref.PIPES) + " end"
_PRICE = "case {0} " + " ".join(f"when {dn} then {price}" for dn, _, _, price, *_ in ref.PIPES) + " end"
_TREE = "tree as (select c_custkey as node, case when c_custkey > 0 then c_custkey // 4 end as parent, c_custkey % 40 + 1 as flow from customer)"
_UP = f"{_TREE}, up as (select node, node as ancestor, 0 as depth from tree union all select u.node, t.parent, u.depth + 1 from up u join tree t on t.node = u.ancestor where t.parent is not null)"
_SUPPLIERS = "s as (select s_suppkey, ((s_suppkey + 3) * 7919) % 1000 as x, ((s_suppkey + 3) * 104729) % 1000 as y from supplier)"
_CUSTOMERS = "c as (select c_custkey, c_nationkey, (c_custkey * 7919) % 1000 as cx, (c_custkey * 104729) % 1000 as cy from customer)"
_RECTS = "r as (select p_partkey, (p_partkey * 37) % 1000 as x0, (p_partkey * 53) % 1000 as y0, (p_partkey * 37) % 1000 + p_size as x1, (p_partkey * 53) % 1000 + p_size as y1 from part)"
_SHORT = "g as (select c_custkey as k, cx as ax, cy as ay, cx + (c_custkey % 7 - 3) * 2 as bx, cy + (c_custkey % 5 - 2) * 2 + 1 as by_ from c)"
_LENGTHS = f"""{_CUSTOMERS}, l as (
  select k.c_custkey, k.c_nationkey, sqrt((p.cx - k.cx) * (p.cx - k.cx) + (p.cy - k.cy) * (p.cy - k.cy)) as length,
    {_DN.format("(k.c_custkey % 40 + 1)")} as dn, case when k.c_custkey % 5 = 0 then 1.6::double else 1.0::double end as k
  from c k join c p on p.c_custkey = k.c_custkey // 4)"""
_MONEY = "sum({0}::decimal(18,4))::double"

SQL["q01_type_counts"] = "select event_type, count(*) as n from events group by event_type"
SQL["q02_size_by_bracket"] = f"select case when p_size <= 10 then 'small' when p_size <= 30 then 'medium' when p_size <= 45 then 'large' end as bracket, count(*) as n, round({_MONEY.format('p_retailprice')}, 1) as total from part group by 1"
SQL["q03_global_flow_stats"] = f"select count(*) as n, coalesce({_MONEY.format('l_quantity')}, 0) as total, min(l_quantity) as least, max(l_quantity) as most from lineitem"
SQL["q04_filtered_counts"] = "select count(*) as n, count(*) filter (where value > 50) as n_high, count(*) filter (where event_type = 'error') as n_error from events"
SQL["q05_code_multi_agg"] = "select lang, min(source) as first_source, count(*) as n, count(quality) as n_labelled from documents left join labels using (doc_id) group by lang"
SQL["q06_counts_map"] = """select bucket, '{' || string_agg('"' || event_type || '":' || n, ',' order by event_type) || '}' as counts from (select user_id % 10 as bucket, event_type, count(*) as n from events group by all) group by bucket"""
SQL["q07_duplicate_keys"] = "select md5(text) as text_md5, count(*) as n, min(doc_id) as first_id from documents group by 1 having count(*) > 1"
SQL["q08_json_guarded_cast"] = "select event_type, count(k) as n, sum(k) as total, max(k) as most from (select event_type, case when json_type(props, '$.k') in ('UBIGINT', 'BIGINT', 'DOUBLE') then json_extract(props, '$.k')::double end as k from events) group by event_type"
SQL["q09_semi_and_anti"] = """select 'with_orders' as kind, count(*) as n from customer where c_custkey in (select o_custkey from orders)
union all select 'without_orders', count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey)
union all select 'orphan_orders', count(*) from orders where not exists (select 1 from customer where o_custkey = c_custkey)"""
SQL["q10_scalar_subquery_count"] = "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as n_orders from customer"
SQL["q11_pipe_for_flow"] = f"select dn, count(*) as n, {_MONEY.format('flow')} as flow, max({_PRICE.format('dn')}) as price from (select l_quantity * l_quantity * 10 as flow, {_DN.format('(l_quantity * l_quantity * 10)')} as dn from lineitem) group by dn"
_NAMES = ", ".join(f"'{x[0]}'" for x in ref.RULES) + ", 'metro', 'cliff'"
_RULE_ROWS = ", ".join(f"('{n}', '{r}', {d}::double, {k if k is not None else 1.0}::double)" for n, r, d, _, k, _ in ref.RULES)
SQL["q12_rule_lookup_default"] = f"""with t as (select ([{_NAMES}])[p_size % 12 + 1] as restriction_type from part), rules(t, rule, min_distance, k) as (values {_RULE_ROWS})
select restriction_type, coalesce(rule, 'FORBIDDEN') as rule, coalesce(min_distance, 1.0)::double as min_distance, coalesce(k, 1.0)::double as k, count(*) as n from t left join rules on rules.t = restriction_type group by all"""
SQL["q13_subtree_flow"] = f"with recursive {_UP} select u.ancestor as node, sum(t.flow)::bigint as flow, count(*) as n, (select max(depth) from up d where d.node = u.ancestor)::bigint as depth from up u join tree t on t.node = u.node group by u.ancestor"
SQL["q14_chain_states"] = """with recursive t as (select c_custkey as node, case when c_custkey % 101 = 7 then -1 when c_custkey % 103 = 11 then c_custkey * 4 when c_custkey > 0 then c_custkey // 4 end as parent from customer),
w as (select node, node as cur, 0 as steps from t union all select w.node, t.parent, steps + 1 from w join t on t.node = w.cur where w.cur <> 0 and steps < 40),
e as (select node, arg_max(cur, steps) as cur from w group by node)
select e.node, case when cur = 0 then 'root' when cur is null or cur not in (select node from t) then 'broken' else 'cycle' end as state from e"""
SQL["q15_monotone_parent"] = f"with {_TREE}, d as (select node, parent, {_DN.format('flow')} as dn from tree) select a.node, a.parent, a.dn, b.dn as parent_dn from d a join d b on b.node = a.parent where b.dn < a.dn"
SQL["q16_equal_runs"] = f"""with recursive {_UP}, k as (select node, depth, (ancestor // 7) % 3 as kind from up),
c as (select *, case when kind = lag(kind) over (partition by node order by depth) then 0 else 1 end as fresh from k),
i as (select node, sum(fresh) over (partition by node order by depth) as island from c),
r as (select node, island, count(*) as length from i group by all) select node, count(*) as n_runs, max(length) as longest from r group by node"""
SQL["q17_suffix_sum"] = f"with q as (select l_orderkey, l_linenumber, {_MONEY.format('l_quantity')} as quantity from lineitem group by all) select *, sum(quantity) over (partition by l_orderkey order by l_linenumber rows between current row and unbounded following) as beyond from q"
SQL["q18_distinct_top2"] = """with a as (select o_custkey, o_orderstatus, o_orderkey, o_totalprice, row_number() over (partition by o_custkey, o_orderstatus order by o_totalprice desc, o_orderkey) as r from orders),
b as (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from a where r = 1) select o_custkey, rank, o_orderkey, o_totalprice from b where rank <= 2"""
SQL["q19_retention"] = """with a as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders where o_orderstatus <> 'P')
select o_custkey as dataset_id, count(*) as n, max(o_orderkey) as last_id from a where r > 3 and o_orderdate < timestamp '2001-08-01 00:00:00' - interval (24 * 365) hour group by o_custkey"""
SQL["q20_examples_capped"] = "select event_type, event_id, n from (select event_type, event_id, row_number() over (partition by event_type order by event_id) as r, count(*) over (partition by event_type) as n from events) where r <= 50"
SQL["q21_interval_merge"] = """with a as (select l_orderkey, ((l_linenumber * 7) % 20 * 100)::bigint as low, ((l_linenumber * 7) % 20 * 100 + floor(l_quantity)::bigint % 10 * 100)::bigint as high, (100 + floor(l_discount * 100))::bigint as k from lineitem),
b as (select *, max(high) over (partition by l_orderkey order by low, high rows between unbounded preceding and 1 preceding) as reach from a),
c as (select *, sum(case when low <= reach + 1 then 0 else 1 end) over (partition by l_orderkey order by low, high rows unbounded preceding) as island from b)
select l_orderkey, min(low) as low, max(high) as high, max(k) as k from c group by l_orderkey, island"""
SQL["q22_turn_angles"] = f"""with {_CUSTOMERS}, p as (select c_custkey, lag(cx) over w as x0, lag(cy) over w as y0, cx as x1, cy as y1, lead(cx) over w as x2, lead(cy) over w as y2 from c window w as (partition by c_nationkey order by c_custkey)),
v as (select c_custkey, (x1 - x0)::double as ux, (y1 - y0)::double as uy, (x2 - x1)::double as vx, (y2 - y1)::double as vy from p where x0 is not null and x2 is not null)
select c_custkey, round(degrees(acos(greatest(-1.0::double, least(1.0::double, (ux * vx + uy * vy) / sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy)))))), 6) as turn from v where ux * ux + uy * uy > 0 and vx * vx + vy * vy > 0"""
SQL["q23_nearest_one"] = f"with {_SUPPLIERS}, {_CUSTOMERS}, d as (select s_suppkey, c_custkey, (cx - x) * (cx - x) + (cy - y) * (cy - y) as d2 from s, c) select s_suppkey, c_custkey, d2::double as d2 from (select *, row_number() over (partition by s_suppkey order by d2, c_custkey) as r from d) where r = 1"
SQL["q24_within_radius"] = f"with {_SUPPLIERS}, {_CUSTOMERS} select s_suppkey, count(*) as n, sum((cx - x) * (cx - x) + (cy - y) * (cy - y))::bigint as d2 from s join c on (cx - x) * (cx - x) + (cy - y) * (cy - y) <= 1600 group by s_suppkey"
SQL["q25_box_join"] = f"with {_SUPPLIERS}, {_RECTS} select s_suppkey, count(*) as n, min(p_partkey) as first_part from s join r on x between x0 and x1 and y between y0 and y1 group by s_suppkey"
SQL["q26_smallest_area"] = f"with {_SUPPLIERS}, {_RECTS} select s_suppkey, p_partkey from (select s_suppkey, p_partkey, row_number() over (partition by s_suppkey order by (x1 - x0) * (y1 - y0), p_partkey) as n from s join r on x between x0 and x1 and y between y0 and y1) where n = 1"
_SIDE = "sign(({0}.bx - {0}.ax) * ({1} - {0}.ay) - ({0}.by_ - {0}.ay) * ({2} - {0}.ax))"
_LONG = "g as (select c_custkey as k, cx as ax, cy as ay, cx + (c_custkey % 7 - 3) * 20 as bx, cy + ((c_custkey % 5 - 2) * 2 + 1) * 10 as by_ from c)"
_NEAR = "least({0}.ax, {0}.bx) <= greatest({1}.ax, {1}.bx) and least({1}.ax, {1}.bx) <= greatest({0}.ax, {0}.bx) and least({0}.ay, {0}.by_) <= greatest({1}.ay, {1}.by_) and least({1}.ay, {1}.by_) <= greatest({0}.ay, {0}.by_)"
SQL["q27_segment_crossings"] = f"""with {_CUSTOMERS}, {_LONG} select a.k as a, b.k as b from g a join g b on a.k < b.k and {_NEAR.format('a', 'b')}
where {_SIDE.format('a', 'b.ay', 'b.ax')} * {_SIDE.format('a', 'b.by_', 'b.bx')} < 0 and {_SIDE.format('b', 'a.ay', 'a.ax')} * {_SIDE.format('b', 'a.by_', 'a.bx')} < 0"""
_ON = "({2} between least({0}.ax, {0}.bx) and greatest({0}.ax, {0}.bx) and {1} between least({0}.ay, {0}.by_) and greatest({0}.ay, {0}.by_) and " + _SIDE + " = 0)"
_MEET = f"""({_SIDE.format('a', 'b.ay', 'b.ax')} * {_SIDE.format('a', 'b.by_', 'b.bx')} < 0 and {_SIDE.format('b', 'a.ay', 'a.ax')} * {_SIDE.format('b', 'a.by_', 'a.bx')} < 0
  or {_ON.format('a', 'b.ay', 'b.ax')} or {_ON.format('a', 'b.by_', 'b.bx')} or {_ON.format('b', 'a.ay', 'a.ax')} or {_ON.format('b', 'a.by_', 'a.bx')})"""
SQL["q28_clip_intervals"] = f"""with {_CUSTOMERS}, {_SHORT}, {_RECTS}, j as (select k, ax, ay, (bx - ax)::double as dx, (by_ - ay)::double as dy, x0, y0, x1, y1 from g join r on least(ax, bx) <= x1 and greatest(ax, bx) >= x0 and least(ay, by_) <= y1 and greatest(ay, by_) >= y0),
t as (select k, greatest(0, case when dx = 0 then 0 else least((x0 - ax) / dx, (x1 - ax) / dx) end, case when dy = 0 then 0 else least((y0 - ay) / dy, (y1 - ay) / dy) end) as low,
  least(1, case when dx = 0 then 1 else greatest((x0 - ax) / dx, (x1 - ax) / dx) end, case when dy = 0 then 1 else greatest((y0 - ay) / dy, (y1 - ay) / dy) end) as high from j)
select k as c_custkey, count(*) as n, round(sum(high - low), 6) as inside from t where low < high group by k"""
SQL["q29_utm_round_trip"] = """with p as (select s_suppkey, 37 + (s_suppkey % 1000) / 1000.0::double * 4 as lon, 55 + (s_suppkey % 777) / 777.0::double as lat, 1 / 298.257223563::double as f from supplier),
q as (select *, f / (2 - f) as n from p),
r as (select *, 2 * sqrt(n) / (1 + n) as e, sin(radians(lat)) as s, radians(lon - 39) as dl, 6378137.0::double / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) as a from q),
u as (select *, sinh(atanh(s) - e * atanh(e * s)) as t from r),
v as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 as a1, 13 * n * n / 48 - 3 * n * n * n / 5 as a2, 61 * n * n * n / 240 as a3 from u)
select s_suppkey, round(500000 + 0.9996::double * a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) as east,
  round(0.9996::double * a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) as north, true as returns from v"""
SQL["q30_extent"] = f"with {_CUSTOMERS} select min(cx) as x0, min(cy) as y0, max(cx) as x1, max(cy) as y1 from c"
SQL["q31_mean_direction"] = "select c_nationkey, round(atan2(sum((1 + c_custkey % 9) * sin(4 * radians((c_custkey * 37) % 360))), sum((1 + c_custkey % 9) * cos(4 * radians((c_custkey * 37) % 360)))) / 4, 6) as heading from customer group by c_nationkey"
_ROUNDED = "(floor(length * 1000 + 0.5) / 1000.0::double)"
SQL["q32_cost_and_score"] = f"""with {_LENGTHS}, p as (select *, floor({_ROUNDED} * ({_PRICE.format('dn')}) * k * 100 + 0.5) / 100.0::double as cost from l),
a as (select c_nationkey, {_MONEY.format('cost')} as cost, {_MONEY.format(_ROUNDED)} as length from p group by c_nationkey)
select c_nationkey, round(cost, 2) as cost, round(length, 3) as length, round(0.7::double * cost / 25000000 + 0.3::double * length / 100, 6) as score from a"""
SQL["q33_chamber_cost"] = f"""with {_LENGTHS}, e as (select c_custkey as chamber, dn from l union all select c_custkey // 4, dn from l where c_custkey > 0), m as (select chamber, max(dn) as dn, count(*) as degree from e group by chamber)
select *, case when dn <= 200 then 3000000 when dn <= 500 then 5000000 when dn <= 1000 then 8000000 else 12000000 end as cost from m"""
SQL["q34_sum_consistency"] = f"""with s as (select l_orderkey, {_MONEY.format('l_extendedprice')} as total, count(*) as n from lineitem group by l_orderkey)
select o_orderstatus, count(*) as n, count(*) filter (where total is null or abs(total - o_totalprice) > 0.05::double * s.n + 1e-7 * abs(o_totalprice)) as n_off from orders left join s on l_orderkey = o_orderkey group by o_orderstatus"""
SQL["q35_structure_signature"] = "select o_custkey, string_agg(x, ',' order by x) as signature from (select o_custkey, o_orderstatus || '-' || substr(o_orderpriority, 1, 1) as x from orders) group by o_custkey"
SQL["q36_compare_metrics"] = f"""with v as (select l_returnflag as variant, {_MONEY.format('l_extendedprice')} as cost, {_MONEY.format('l_quantity')} as length, count(*)::double as n_segments from lineitem where l_returnflag in ('A', 'R') group by 1),
u as (unpivot v on cost, length, n_segments into name metric value value), w as (select metric, max(value) filter (where variant = 'A') as a, max(value) filter (where variant = 'R') as b from u group by metric)
select metric, a, b, round(b - a, 4) as delta, case when abs(b - a) <= 1e-9 * greatest(abs(a), abs(b), 1) then 'same' when b > a then 'a' else 'b' end as better from w"""
SQL["q37_only_a_only_b"] = """with a as (select distinct o_custkey from orders where o_orderstatus = 'F'), b as (select distinct o_custkey from orders where o_orderstatus = 'O')
select o_custkey, 'only_a' as side from (from a except from b) union all select o_custkey, 'only_b' from (from b except from a) union all select o_custkey, 'common' from (from a intersect from b)"""
SQL["q38_edits"] = """with p as (select p_partkey as fid, p_brand as object_type, case when p_partkey % 14 = 0 then null when p_partkey % 7 = 0 then '99' else p_size::varchar end as value from part where p_partkey % 10 <> 3
union all select -p_partkey, 'added', p_size::varchar from part where p_partkey % 50 = 1)
select object_type, count(*) as n, count(value) as n_value, sum(value::bigint)::bigint as total from p group by object_type"""
SQL["q39_version_lineage"] = "select p_partkey - p_partkey % 9 as root_id, count(*) as n, max(p_partkey) as newest, (max(p_size) + 1)::bigint as next_version from part group by 1"
SQL["q40_null_safe_diff"] = """with p as (select p_partkey, p_brand as brand, p_type as kind, case when p_size % 3 > 0 then p_size::varchar end as size from part),
j as (select unnest([{'name': 'brand', 'b': a.brand, 'a': b.brand}, {'name': 'kind', 'b': a.kind, 'a': b.kind}, {'name': 'size', 'b': a.size, 'a': b.size}]) as u from p a join p b on b.p_partkey = a.p_partkey + 1)
select u.name as name, count(*) as n, count(u.b) as n_before from j where u.a is distinct from u.b group by 1"""
SQL["q41_top3_differences"] = """with m as (select s_nationkey, sum(s_acctbal::decimal(18,4))::double / count(*) as mean from supplier group by s_nationkey),
d as (select s_nationkey, s_suppkey, round(s_acctbal::decimal(18,4)::double - mean, 3) as delta from supplier join m using (s_nationkey))
select s_nationkey, rank, s_suppkey, delta from (select *, row_number() over (partition by s_nationkey order by abs(delta) desc, s_suppkey) as rank from d) where rank <= 3"""
SQL["q42_tile_keys"] = """with p as (select 37 + (s_suppkey % 1000) / 1000.0::double * 4 as lon, 55 + (s_suppkey % 777) / 777.0::double as lat, unnest(range(9, 17)) as z from supplier)
select z::int as z, floor((lon + 180) / 360 * 2 ** z)::bigint as x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2 ** z)::bigint as y, count(*) as n from p group by all"""
SQL["q43_readiness"] = "select user_id % 7 as dataset, count(*) filter (where event_type = 'error') as errors, count(*) filter (where event_type like 'c%') as core, count(*) filter (where event_type = 'error') = 0 as ready from events group by 1"
SQL["q44_id_type"] = "with i as (select (doc_id % 3 - 1)::varchar as id from documents union all select regexp_extract(url, '([^/]*)$', 1) from pages) select regexp_matches(id, '^(0|-?[1-9][0-9]{0,17})$') as is_number, count(*) as n from i group by 1"
SQL["q45_journal_after"] = "select event_id, event_type, value from events where event_id >= 9000"
SQL["q46_point_to_segment"] = """with p as (select s_suppkey as k, ((s_suppkey + 3) * 7919) % 1000 as x, ((s_suppkey + 3) * 104729) % 1000 as y, (s_suppkey * 7919) % 1000 as ax, (s_suppkey * 104729) % 1000 as ay,
  ((s_suppkey * 2 + 1) * 7919) % 1000 as bx, ((s_suppkey * 2 + 1) * 104729) % 1000 as by_ from supplier),
t as (select *, case when ax = bx and ay = by_ then 0.0::double else greatest(0.0::double, least(1.0::double, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay))::double / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) end as t from p)
select k as s_suppkey, round(sqrt((ax + t * (bx - ax) - x) ** 2 + (ay + t * (by_ - ay) - y) ** 2), 6) as distance from t"""
SQL["q47_union_and_run_lists"] = "select o_orderkey, c_name from (select o_orderkey, c_name, o_orderdate from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F' order by o_orderdate desc, o_orderkey limit 100)"
SQL["q49_segments_meet"] = f"""with {_CUSTOMERS}, {_LONG}, m as (select a.k as i, b.k as j from g a join g b on a.k < b.k and {_NEAR.format('a', 'b')} where {_MEET})
select c_custkey, count(*) as n from (select i as c_custkey from m union all select j from m) group by 1"""
SQL["q50_segment_meets_area"] = f"""with {_CUSTOMERS}, {_LONG}, d as (select s_suppkey, (s_suppkey * 7919) % 1000 + 1 as x, (s_suppkey * 104729) % 1000 + 2 as y, s_suppkey % 30 + 2 as r from supplier),
e as (select s_suppkey, x + r as ax, y as ay, x as bx, y + r as by_ from d union all select s_suppkey, x, y + r, x - r, y from d union all select s_suppkey, x - r, y, x, y - r from d union all select s_suppkey, x, y - r, x + r, y from d),
m as (select b.s_suppkey, a.k from g a join e b on {_NEAR.format('a', 'b')} where {_MEET} union select s_suppkey, k from g join d on abs(ax - x) + abs(ay - y) < r)
select s_suppkey, count(*) as n, sum(k)::bigint as keys from m group by 1"""
SQL["q51_features_by_id"] = "select l_partkey, count(*) as n from (select l_partkey from lineitem where l_partkey = 7 order by l_orderkey limit 100) group by 1"
SQL["q52_features_of_issue"] = "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3) order by o_orderkey limit 5000"
SQL["q53_issue_filter"] = "select 'code.' || (user_id % 10) as code, event_type as severity, event_id as seq from events where event_type = 'error' order by code, seq limit 500"
SQL["q54_version_copy"] = "select dataset_id, count(*) as n, sum(p_partkey)::bigint as keys from (select p_size::int as dataset_id, p_partkey from part union all select 1000, p_partkey from part where p_size = 1) group by 1"
SQL["q55_fallback_join"] = """select geom, count(*) as n, sum(c_custkey)::bigint as keys from (select c_custkey, case when a.s_suppkey is not null then 'footprint' when b.s_suppkey is not null then 'point' end as geom
from customer left join supplier a on a.s_suppkey = c_custkey and a.s_nationkey < 10 left join supplier b on b.s_suppkey * 2 = c_custkey) group by 1"""
SQL["q56_run_scores"] = """select case o_orderkey % 3 when 0 then 0 when 1 then 2 end::int as variants, count(*) as n, sum(case when o_orderkey % 3 = 1 then least(o_orderkey % 7, o_custkey % 5)::double end) as scores from orders group by 1"""
SQL["q57_latency"] = """with r as (select event_type, value, row_number() over (partition by event_type order by value) as i, count(*) over (partition by event_type) as n from events where value is not null)
select event_type, n, max(value) filter (where i = greatest(1, (50 * n + 99) // 100)) as p50, max(value) filter (where i = greatest(1, (95 * n + 99) // 100)) as p95, max(value) as longest from r group by event_type, n"""
SQL["q58_running_length"] = """with l as (select l_orderkey, l_linenumber, l_partkey % 90 + 10 as length from lineitem), p as (select l_orderkey, coalesce(sum(length) over (partition by l_orderkey order by l_linenumber, length rows between unbounded preceding and 1 preceding), 0) as position from l)
select l_orderkey, sum(position)::bigint as positions, max(position)::bigint as last from p group by 1"""
SQL["q59_kinds_by_count"] = "select p_brand, count(*) as n, (row_number() over (order by count(*) desc, p_brand))::int as place from part group by 1"
_CONSUMERS = "k as (select c_custkey, c_nationkey, c_custkey // 5 as branch, (c_custkey * 7919) % 1000 as distance, c_custkey % 40 + 1 as flow from customer)"
SQL["q60_three_orders"] = f"""with {_CONSUMERS} select c_custkey, (row_number() over (partition by c_nationkey order by distance, c_custkey))::int as near, (row_number() over (partition by c_nationkey order by distance desc, c_custkey desc))::int as far,
(row_number() over (partition by c_nationkey order by flow desc, distance, c_custkey))::int as by_flow from k"""
SQL["q61_group_orders"] = f"""with {_CONSUMERS}, o as (select branch, string_agg(c_custkey::varchar, ',' order by distance desc, c_custkey desc) as far, string_agg(c_custkey::varchar, ',' order by flow desc, distance, c_custkey) as by_flow,
  string_agg(c_custkey::varchar, ',' order by distance, c_custkey) as near from k where c_custkey % 7 <> 0 group by branch having count(*) between 2 and 6)
select branch, len(list_distinct([far, by_flow, near]))::int as n, far, case when near <> far and near <> by_flow then near when by_flow <> far then by_flow else far end as last from o"""
SQL["q62_alternatives"] = """with t as (select s_nationkey, s_suppkey, (s_suppkey * 37) % 101 as score, row_number() over (partition by s_nationkey order by s_suppkey % 11 <> 0, s_suppkey) = 1 as chosen from supplier),
r as (select *, row_number() over (partition by s_nationkey order by score, s_suppkey) as r from t), w as (select *, max(case when chosen then r end) over (partition by s_nationkey) as c from r)
select s_nationkey, s_suppkey, least(r, 6)::int as place, chosen from w where chosen or r <= case when c > 6 then 5 else 6 end"""
SQL["q63_derived_upstream"] = """with recursive w(id, upstream, depth) as (select c_custkey::bigint, 0::bigint, 1 from customer where c_custkey > 0 and c_custkey // 4 = 0
union all select c.c_custkey, w.id, w.depth + 1 from customer c join w on c.c_custkey // 4 = w.id and c.c_custkey > 0) select id, upstream, depth::int as depth from w"""
_GAP = "sqrt((ax + t{0} * (bx - ax) - x{0}) ** 2 + (ay + t{0} * (by_ - ay) - y{0}) ** 2)"
_PLACE = "greatest(0.0::double, least(1.0::double, ((x{0} - ax) * (bx - ax) + (y{0} - ay) * (by_ - ay))::double / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) as t{0}"
SQL["q64_oriented_lines"] = f"""with p as (select s_suppkey, ((s_suppkey + 3) * 7919) % 1000 as x1, ((s_suppkey + 3) * 104729) % 1000 as y1, (s_suppkey * 3 * 7919) % 1000 as x2, (s_suppkey * 3 * 104729) % 1000 as y2, (s_suppkey * 7919) % 1000 as ax, (s_suppkey * 104729) % 1000 as ay,
  ((s_suppkey * 2 + 1) * 7919) % 1000 as bx, ((s_suppkey * 2 + 1) * 104729) % 1000 as by_ from supplier), t as (select *, case when ax = bx and ay = by_ then null else [0] end as ok, {_PLACE.format(1)}, {_PLACE.format(2)} from p)
select s_suppkey, {_GAP.format(2)} < {_GAP.format(1)} as reversed, round(least({_GAP.format(1)}, {_GAP.format(2)}), 6) as gap from t"""
SQL["q65_place_names"] = "select c.c_custkey::bigint as id, case when u.c_custkey is not null and c.c_custkey % 3 <> 0 then u.c_custkey else c.c_custkey end::bigint as place from customer c left join customer u on u.c_custkey = c.c_custkey // 4"
SQL["q66_branch_groups"] = """with recursive n as (select c_custkey as node, case when c_custkey > 0 then c_custkey // 4 end as parent from customer), t as (select node, parent, node not in (select parent from n where parent is not null) as consumer from n),
u(node, ancestor) as (select node, node from t union all select u.node, t.parent from u join t on t.node = u.ancestor where t.parent in (select node from n)),
s as (select ancestor as node, count(*) filter (where consumer) as n, sum(u.node % 5)::bigint as shape, sum(u.node % 9 + 1)::bigint as length from u join t on t.node = u.node group by 1)
select s.node, n, shape, length, round(shape::double / length, 9) as density from s join t on t.node = s.node where n between 2 and 6 and not consumer"""
_DN = "case " + " ".join(f"when flow <= {c} + 1e-9 then {dn}" for dn, c, *_ in ref.PIPES) + " end"
_BY_DN = lambda column: "case dn " + " ".join(f"when {p[0]} then {p[column]}::double" for p in ref.PIPES) + " end"
SQL["q67_new_costs"] = f"""with p as (select distinct p_size::int as size, p_partkey % 2 = 0 as building from part), f as (select *, size * 100.0::double as flow from p), d as (select *, {_DN} as dn from f)
select size, building, dn, round(case when building then case when dn < 500 then 5.0::double when dn < 900 then 7.0::double else 9.0::double end else 2.2::double end + {_BY_DN(4)} / 2, 6) as clearance,
case when building then size % 3 * 5000000 else 0 end::bigint as tie_in, round(coalesce({_BY_DN(1)} * 0.5::double, 0.0::double), 6) as flow from d"""
_RESULT = """s as (select c_custkey::bigint as k, c_custkey // 4 as up, (c_custkey % 40 + 1)::double as flow, [50, 65, 80, 100][c_custkey % 4 + 1] as dn, (c_custkey % 90 + 10)::double as metres from customer where c_custkey > 0)"""
_FINDING = "select '{0}' as rule, 'ERROR' as severity, {1}::bigint as variant_id, {2}::varchar as feature_id, {3} as message "
SQL["q68_rule_lengths"] = f"with {_RESULT} {_FINDING.format('R-LEN', 1, 'k', repr('length differs from the geometry'))} from s where k % 5 = 0"
SQL["q69_rule_turns"] = f"""with p as (select p_partkey as k, (p_partkey * 7919) % 1000 as ax, (p_partkey * 104729) % 1000 as ay, ((p_partkey + 1) * 7919) % 1000 as bx, ((p_partkey + 1) * 104729) % 1000 as by_,
  ((p_partkey * 3 + 2) * 7919) % 1000 as cx, ((p_partkey * 3 + 2) * 104729) % 1000 as cy from part),
v as (select k, bx - ax as ux, by_ - ay as uy, cx - bx as vx, cy - by_ as vy from p)
{_FINDING.format('R-TURN', 'k % 3', 'k', repr('turns by more than the limit'))} from v where (ux <> 0 or uy <> 0) and (vx <> 0 or vy <> 0)
and degrees(acos(greatest(-1.0::double, least(1.0::double, (ux * vx + uy * vy) / sqrt((ux * ux + uy * uy)::double * (vx * vx + vy * vy)))))) > {ref.MAX_TURN + ref.TURN_TOLERANCE}"""
SQL["q70_rule_ids"] = f"""with i as (select l_linenumber % 3 as v, l_orderkey::varchar as fid from lineitem union all select p_partkey % 3, p_partkey::varchar from part)
{_FINDING.format('OUT-ID', 'v', 'fid', repr('id is used more than once'))} from i group by v, fid having count(*) > 1"""
SQL["q71_rule_one_parent"] = f"with p as (select l_suppkey % 3 as v, l_orderkey from lineitem) {_FINDING.format('R-NET-4', 'v', 'l_orderkey', repr('more than one way to the network'))} from p group by v, l_orderkey having count(*) > 1"
SQL["q72_rule_diameters"] = f"""with {_RESULT} {_FINDING.format('R-NET-9', 1, 'k', repr('diameter is too small for the flow'))} from s where dn < {_DN.format('flow')}
union all {_FINDING.format('R-NET-9', 1, 's.k', repr('diameter falls towards the network'))} from s join s u on u.k = s.up where u.dn < s.dn"""
SQL["q73_rule_flows"] = f"""with recursive {_RESULT}, u as (select k, k as top, case when k % 3 = 0 then flow else 0 end as own from s union all select u.k, s.up, u.own from u join s on s.k = u.top where s.up > 0),
t as (select top as k, sum(own) as total from u group by 1) {_FINDING.format('R-NET-8', 1, 'k', "'flow should be ' || round(total, 3)::varchar")} from s join t using (k) where flow <> total"""
SQL["q74_rule_costs"] = f"with {_RESULT} {_FINDING.format('R-COST', 1, 'k', repr('cost differs from price by length'))} from s where abs(metres * ({_PRICE.format('dn')} - 78631)) > 0.05"
SQL["q75_rule_degrees"] = f"""with {_RESULT}, e as (select k as node, dn from s union all select up, dn from s), d as (select node, max(dn) as most, count(*) as degree from e group by 1),
c as (select c_custkey as k, case when c_custkey % 2 = 0 then 100 else 80 end as dn from customer), j as (select * from c left join d on node = k)
{_FINDING.format('R-TIE-3', 1, 'k', repr('diameter or cost of the chamber'))} from j where dn is distinct from most
union all {_FINDING.format('R-NET-5', 1, 'k', repr('too many pieces meet'))} from j where degree > {ref.MAX_DEGREE}"""
_CORNERS = [[(-4, -4), (4, -4), (4, 4), (1, 4), (1, 0), (-1, 0), (-1, 4), (-4, 4), (-4, -4)], [(-3, -3), (3, -3), (3, -1), (-3, -1), (-3, -3)]]
_WALLS = "(values " + ", ".join(f"({a}, {b}, {c}, {d})" for ring in _CORNERS for (a, b), (c, d) in zip(ring, ring[1:], strict=False)) + ") u(a, b, c, d)"
_YARDS = f"""y as (select s_suppkey as s, (s_suppkey * 7919) % 1000 + 1 as x, (s_suppkey * 104729) % 1000 + 2 as y, s_suppkey % 6 + 2 as m from supplier),
e as (select s, (x + m * a)::double as ax, (y + m * b)::double as ay, (x + m * c)::double as bx, (y + m * d)::double as by_ from y, {_WALLS})"""
_IN_RINGS = "(select count(*) % 2 = 1 from e where e.s = {0}.s and (e.ay > {2}) <> (e.by_ > {2}) and {1} < (e.bx - e.ax) * ({2} - e.ay) / nullif(e.by_ - e.ay, 0) + e.ax)"
_STRETCHES = f"""{_CUSTOMERS}, {_LONG}, {_YARDS},
j as (select k, s, ax, ay, (bx - ax)::double as dx, (by_ - ay)::double as dy from g join y on least(ax, bx) <= x + 4 * m and greatest(ax, bx) >= x - 4 * m and least(ay, by_) <= y + 4 * m and greatest(ay, by_) >= y - 4 * m),
w as (select k, j.s, dx, dy, e.bx - e.ax as ux, e.by_ - e.ay as uy, e.ax - j.ax as px, e.ay - j.ay as py, dx * dx + dy * dy as l2 from j join e on e.s = j.s),
h as (select k, s, true as along, greatest(0, least((px * dx + py * dy) / l2, ((px + ux) * dx + (py + uy) * dy) / l2)) as low, least(1, greatest((px * dx + py * dy) / l2, ((px + ux) * dx + (py + uy) * dy) / l2)) as high
  from w where dx * uy = dy * ux and px * dy = py * dx
  union all select k, s, false, t, t from (select k, s, (px * uy - py * ux) / (dx * uy - dy * ux) as t, (px * dy - py * dx) / (dx * uy - dy * ux) as u from w where dx * uy <> dy * ux) where t between 0 and 1 and u between 0 and 1),
p as (select * from h where low <= high),
t as (select k, s, low as t from p union select k, s, high from p union select k, s, v::double from j, (values (0), (1)) z(v)),
i as (select k, s, t as low, lead(t) over (partition by k, s order by t) as high from t),
r as (select i.*, ax + dx * (low + high) / 2 as mx, ay + dy * (low + high) / 2 as my, sqrt(dx * dx + dy * dy) as length from i join j using (k, s) where high - low >= 1e-12),
held as (select * from r where {_IN_RINGS.format('r', 'mx', 'my')} or exists (select 1 from p where p.k = r.k and p.s = r.s and along and (r.low + r.high) / 2 between p.low and p.high)),
isles as (select *, sum(fresh) over (partition by k, s order by low) as isle from (select *, case when abs(low - lag(high) over (partition by k, s order by low)) < 1e-12 then 0 else 1 end as fresh from held)),
stretch as (select k, s, min(low) as low, max(high) as high, any_value(length) as length from isles group by k, s, isle)"""
SQL["q76_inside_stretches"] = f"with {_STRETCHES} select k as c_custkey, s as s_suppkey, count(*) as n, round(max(high), 6) as last, round(sum(high - low), 6) as inside from stretch group by k, s"
SQL["q77_merged_stretches"] = f"""with {_STRETCHES}, q as (select k, low * length as low, high * length as high from stretch),
b as (select *, max(high) over (partition by k order by low, high rows between unbounded preceding and 1 preceding) as far from q),
f as (select *, sum(case when low <= far + 0.2::double then 0 else 1 end) over (partition by k order by low, high rows unbounded preceding) as isle from b),
o as (select k, min(low) as low, max(high) as high from f group by k, isle) select k as c_custkey, count(*) as n, round(sum(high - low), 6) as length from o group by k"""
_OFF = "({2} and not (({0}.ax = {1}.ax and {0}.ay = {1}.ay) or ({0}.bx = {1}.ax and {0}.by_ = {1}.ay)) or {3} and not (({0}.ax = {1}.bx and {0}.ay = {1}.by_) or ({0}.bx = {1}.bx and {0}.by_ = {1}.by_)))"
SQL["q78_rule_crossings"] = f"""with {_CUSTOMERS}, {_LONG} {_FINDING.format('R-NET-7', 'a.k % 3', 'a.k', "'meets ' || b.k || ' outside a common end'")} from g a join g b on a.k % 3 = b.k % 3 and a.k::varchar < b.k::varchar and {_NEAR.format('a', 'b')}
where ({_SIDE.format('a', 'b.ay', 'b.ax')} * {_SIDE.format('a', 'b.by_', 'b.bx')} < 0 and {_SIDE.format('b', 'a.ay', 'a.ax')} * {_SIDE.format('b', 'a.by_', 'a.bx')} < 0)
or {_OFF.format('a', 'b', _ON.format('a', 'b.ay', 'b.ax'), _ON.format('a', 'b.by_', 'b.bx'))} or {_OFF.format('b', 'a', _ON.format('b', 'a.ay', 'a.ax'), _ON.format('b', 'a.by_', 'a.bx'))}"""
_FAR = "(with t as (select greatest(0, least(1, (({1} - {0}.ax) * ({0}.bx - {0}.ax) + ({2} - {0}.ay) * ({0}.by_ - {0}.ay))::double / (({0}.bx - {0}.ax) * ({0}.bx - {0}.ax) + ({0}.by_ - {0}.ay) * ({0}.by_ - {0}.ay)))) as t) select sqrt(({0}.ax + t * ({0}.bx - {0}.ax) - {1}) ** 2 + ({0}.ay + t * ({0}.by_ - {0}.ay) - {2}) ** 2) from t)"
SQL["q79_rule_walls"] = f"""with {_CUSTOMERS}, {_LONG}, {_YARDS}, j as (select g.*, s, s % 4 + 1 as least_ from g join y on least(ax, bx) <= x + 4 * m + 4 and greatest(ax, bx) >= x - 4 * m - 4 and least(ay, by_) <= y + 4 * m + 4 and greatest(ay, by_) >= y - 4 * m - 4),
n as (select a.k, a.s, a.least_, least({_FAR.format('a', 'b.ax', 'b.ay')}, {_FAR.format('a', 'b.bx', 'b.by_')}, {_FAR.format('b', 'a.ax', 'a.ay')}, {_FAR.format('b', 'a.bx', 'a.by_')}) as d,
  {_SIDE.format('a', 'b.ay', 'b.ax')} * {_SIDE.format('a', 'b.by_', 'b.bx')} < 0 and {_SIDE.format('b', 'a.ay', 'a.ax')} * {_SIDE.format('b', 'a.by_', 'a.bx')} < 0 as crosses from j a join e b on a.s = b.s),
f as (select k, s from n where crosses or d < least_ - 0.01 union select k, s from j where {_IN_RINGS.format('j', 'j.ax', 'j.ay')})
select k::varchar as feature_id, count(*) as n, min('too close to ' || s) as first from f group by k"""
_RUN = "case dn " + " ".join(f"when {p[0]} then {p[2]}" for p in ref.PIPES) + " end"
SQL["q80_rule_run_lengths"] = f"""with recursive {_RESULT}, w as (select k as start, k as here, up, dn, metres * 8 as total from s union all select w.start, s.k, s.up, s.dn, w.total + s.metres * 8 from w join s on s.k = w.up and s.dn = w.dn),
f as (select start, max(total) as total from w group by start), m as (select here as k, dn, max(f.total) as way from w join f using (start) group by here, dn)
{_FINDING.format('R-NET-10', 1, 'k', repr('pipe of one diameter is too long'))} from m where way > {_RUN} + 0.05"""
SQL["q81_rule_rings"] = f"""with recursive s as (select c_custkey as k, case when c_custkey % 101 = 7 then -1 when c_custkey % 103 = 11 then c_custkey * 4 else c_custkey // 4 end as up from customer where c_custkey > 0),
u as (select k, up as here from s union select u.k, s.up from u join s on s.k = u.here), t as (select k, here from u where here not in (select k from s))
{_FINDING.format('R-NET-1', 1, 'k', repr('does not lead to a tie-in'))} from t where here <> 0
union all {_FINDING.format('R-NET-4', 1, 'k', repr('leads round in a ring'))} from s where k not in (select k from t)"""
SQL["q82_rule_parts"] = f"""with recursive s as (select c_custkey as k, c_custkey // 4 as up from customer where c_custkey > 0 and c_custkey % 97 <> 5),
e as (select k::varchar as fid, k, up from s union all select 'x' || k, k, up from s where k % 50 = 1),
u as (select k, up as here from s union select u.k, s.up from u join s on s.k = u.here), t as (select k, here as root from u where here not in (select k from s)),
n as (select k as node, root from t union select root, root from t),
m as (select root, count(*) as nodes, count(*) filter (where node = 0 or node % 97 = 5 and node % 3 > 0 or node % 200 = 3) as marks from n group by root),
p as (select root, min(fid) as first, count(*) as edges from e join t using (k) group by root), f as (select * from p join m using (root))
{_FINDING.format('R-NET-4', 1, 'first', "'part is not a tree: ' || edges || ' segments, ' || nodes || ' nodes'")} from f where edges <> nodes - 1
union all {_FINDING.format('R-NET-3', 1, 'first', "'part has ' || marks || ' tie-ins, 1 is required'")} from f where marks <> 1"""
SQL["q83_rule_topology"] = f"""with {_RESULT}, e as (select k, k as node from s union all select k, up from s)
{_FINDING.format('R-TOPO', 1, 'k', "'unknown node ' || node")} from e where node % 83 = 9
union all {_FINDING.format('R-TOPO', 1, 'k', "'ends away from node ' || node")} from e where node % 83 <> 9 and node % 71 = 2"""
_LANE = "select {0} // 7 % 4 as v, {0} % {2} as kind, ({0} * 37) % 25 * 40 + ({0} % 2) * {3} as lane, ({0} * 7919) % 1000 as lo, ({0} * 7919) % 1000 + {0} % 90 + 10 as hi from {1}"
_ISLES = """{0}m as (select *, max(hi) over (partition by v, kind, lane order by lo, hi rows between unbounded preceding and 1 preceding) as far from {0}),
{0}f as (select *, sum(case when lo <= far then 0 else 1 end) over (partition by v, kind, lane order by lo, hi rows unbounded preceding) as isle from {0}m),
{0}u as (select v, kind, lane, min(lo) as lo, max(hi) as hi from {0}f group by v, kind, lane, isle)"""
_SLANT = "case when kind = 2 then sqrt(2.0) else 1.0 end"
SQL["q84_union_length"] = f"with s as ({_LANE.format('p_partkey', 'part', 3, 0)}), {_ISLES.format('s')} select v as variant_id, round(sum((hi - lo) * {_SLANT}), 4) as length from su group by v"
SQL["q85_noded"] = f"""with s as ({_LANE.format('p_partkey', 'part', 3, 0)}),
q as (select a.*, b.kind as kb, b.lane as lb, b.lo as blo, b.hi as bhi from s a join s b on a.v = b.v and a.kind <> b.kind),
x as (select *, case when kind = 0 then (case when kb = 1 then lb else lane - lb end) when kind = 1 then (case when kb = 0 then lb else lane + lb end) when kb = 0 then lb - lane else lb end as p,
  case when kb = 0 then (case when kind = 1 then lane else lb - lane end) when kb = 1 then (case when kind = 0 then lane else lane + lb end) when kind = 0 then lane - lb else lane end as pb from q),
t as (select v, kind, lane, lo as p from s union select v, kind, lane, hi from s union select v, kind, lane, p from x where p between lo and hi and pb between blo and bhi),
i as (select *, lead(p) over (partition by v, kind, lane order by p) as n from t),
h as (select *, (n - p) * {_SLANT} as length from i where exists (select 1 from s where s.v = i.v and s.kind = i.kind and s.lane = i.lane and s.lo <= i.p and s.hi >= i.n))
select v as variant_id, count(*) as pieces, round(sum(length), 4) as length, round(max(length), 6) as longest from h group by v"""
_NEAR_LANES = """{2} as (select a.v, a.kind, a.lane, case when a.kind = b.kind then b.lo else b.lane end - sqrt(1 - g * g) as lo, case when a.kind = b.kind then b.hi else b.lane end + sqrt(1 - g * g) as hi
  from (select distinct v, kind, lane from {0}) a join {1} b on a.v = b.v, lateral (select (case when a.kind = b.kind then abs(a.lane - b.lane) else greatest(b.lo - a.lane, a.lane - b.hi, 0) end)::double as g) where g <= 1),
{2}m as (select *, max(hi) over (partition by v, kind, lane order by lo, hi rows between unbounded preceding and 1 preceding) as far from {2}),
{2}f as (select *, sum(case when lo <= far then 0 else 1 end) over (partition by v, kind, lane order by lo, hi rows unbounded preceding) as isle from {2}m),
{2}u as (select v, kind, lane, min(lo) as lo, max(hi) as hi from {2}f group by v, kind, lane, isle),
{2}c as (select u.v, sum(least(u.hi, c.hi) - greatest(u.lo, c.lo)) as common from {0}u u join {2}u c on u.v = c.v and u.kind = c.kind and u.lane = c.lane and u.lo < c.hi and c.lo < u.hi group by u.v)"""
SQL["q86_network_difference"] = f"""with a as ({_LANE.format('p_partkey', 'part', 2, 0.5)}), b as ({_LANE.format('c_custkey', 'customer', 2, 0.25)} where c_custkey % 4 <> 1), {_ISLES.format('a')}, {_ISLES.format('b')},
{_NEAR_LANES.format('a', 'b', 'n')}, {_NEAR_LANES.format('b', 'a', 'w')},
l as (select v, sum(hi - lo) as la, 0 as lb from au group by v union all select v, 0, sum(hi - lo) from bu group by v), t as (select v, sum(la) as la, sum(lb) as lb from l group by v)
select v as variant_id, round(coalesce(nc.common, 0), 4) as common, round(la - coalesce(nc.common, 0), 4) as only_a, round(lb - coalesce(wc.common, 0), 4) as only_b from t left join nc using (v) left join wc using (v)"""
SQL["q87_snapped_ends"] = """with recursive p as (select c_custkey as seq, c_custkey % 64 as g, row_number() over (partition by c_custkey % 64 order by c_custkey) as i, (c_custkey * 7919) % 17 as x, (c_custkey * 104729) % 13 as y from customer),
r as (select g, 0::bigint as i, null::bigint as seq, null::bigint as node, []::struct(seq bigint, x bigint, y bigint)[] as nodes from p group by g
union all select g, i, seq, coalesce(best, seq), case when best is null then list_append(nodes, {'seq': seq::bigint, 'x': x::bigint, 'y': y::bigint}) else nodes end
from (select p.g, p.i, p.seq, p.x, p.y, r.nodes, list_sort(list_transform(list_filter(r.nodes, lambda n: (n.x - p.x) ** 2 + (n.y - p.y) ** 2 <= 4), lambda n: {'d': (n.x - p.x) ** 2 + (n.y - p.y) ** 2, 's': n.seq}))[1].s as best from r join p on p.g = r.g and p.i = r.i + 1))
select seq, node from r where i > 0"""
_LINES = "s as (select c_custkey as k, c_custkey // 4 as up from customer where c_custkey > 0 and c_custkey % 97 <> 5)"
SQL["q88_topology"] = f"""with recursive {_LINES}, u as (select k, up from s where up = 0 union all select s.k, s.up from s join u on s.up = u.k),
c as (select c_custkey as k from customer where c_custkey % 3 = 0)
select u.k as id, 'segment' as kind, case when c.k is not null then u.up + 10000000000 when u.up = 0 then -7 else u.up end as upstream, case when c.k is not null then 'chamber' when u.up = 0 then 'source' else 'segment' end as upstream_kind from u left join c on c.k = u.up
union all select c.k + 10000000000, 'chamber', case when c.k = 0 then -7 else c.k end, case when c.k = 0 then 'source' else 'segment' end from c where c.k = 0 or c.k in (select k from u)
union all select k, 'network.detached_part', null, null from s where k not in (select k from u)"""
SQL["q89_detached_parts"] = f"""with recursive {_LINES}, u as (select k, up as top from s union all select u.k, s.up from u join s on s.k = u.top), t as (select k, top from u where top not in (select k from s))
select count(*) as segments, min(k) as first from t where top <> 0 group by top"""
SQL["q90_merged_lines"] = """with recursive t as (select c_custkey as id, case when c_custkey % 11 = 4 then c_custkey // 2 else c_custkey + 1 end as goal, (c_custkey % 9 + 1)::double as length from customer),
e as (select id, case when id % 3 = 0 then goal else id end as node, 0 as e from t union all select id, case when id % 3 = 0 then id else goal end, 1 from t),
l as (select p.id, p.e, q.id as id2, q.e as e2 from e p join e q on p.node = q.node and (p.id <> q.id or p.e <> q.e) where p.node in (select node from e group by node having count(*) = 2)),
w as (select e.id as start, e.id * 2 + 1 - e.e as key, e.id, e.e as d, 0::bigint as position, 0::double as far from e left join l on l.id = e.id and l.e = e.e where l.id is null
  union all select w.start, w.key, l.id2, l.e2, w.position + 1, w.far + t.length from w join l on l.id = w.id and l.e = 1 - w.d join t on t.id = w.id),
f as (select id, min(struct_pack(key := key, start := start, position := position, d := d, far := far)) as b from w group by id), n as (select b.start as line, count(*) as pieces from f group by 1)
select id, b.start as line, b.position as position, b.d = 0 as forward, b.far as "at", pieces, false as ring from f join n on n.line = b.start"""
