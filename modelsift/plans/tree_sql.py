"""Twins of the grown trees in DuckDB SQL: growth, pruning and Shapley values written out relationally."""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.growth import POISSON, PRIME, PURE, _factors


def _impurity(sums: Sequence[str], classes: int) -> str:
    if classes:
        w = " + ".join(sums)
        return "(1.0" + "".join(f" - coalesce({s} / nullif({w}, 0), 0) * coalesce({s} / nullif({w}, 0), 0)" for s in sums) + ")"
    w, y, yy = sums
    return f"greatest(coalesce({yy} / nullif({w}, 0) - power({y} / nullif({w}, 0), 2), 0), 0)"


def growth(source: str, key: str, label: str, features: Sequence[str], depth: int, *, classes: int, trees: int = 1, bag: bool = False, min_leaf: int = 1, min_split: int = 2, bins: int = 64, seed: int = 42) -> str:
    """CTEs (without ``with``) up to ``nodes`` (tree, id, depth, feature, threshold, n, s0.., imp, weight) and ``at<depth>`` (tree, key, id, w)."""
    k = classes or 3
    s = [f"s{i}" for i in range(k)]
    part = [f"sum(case when y = {c} then w else 0 end)::double as s{c}" for c in range(classes)] or ["sum(w)::double as s0", "sum(w * y)::double as s1", "sum(w * y * y)::double as s2"]
    weight = " + ".join(s) if classes else "s0"
    out = [f"base as materialized (select {key} as key, ({label})::double as y, cast(('0x' || substr(md5(cast({key} as varchar) || '|0'), 1, 15)) as bigint) as h, {', '.join(f'({f})::double as x{i}' for i, f in enumerate(features))} from {source})"]
    for i in range(len(features)):
        shares = ", ".join(repr(j / bins) for j in range(1, bins))
        out.append(
            f"cuts{i} as materialized (select list_sort(list_distinct(case when count(distinct x{i}) <= {bins} then list(x{i}) else quantile_disc(x{i}, [{shares}]) end || [max(x{i})])) as every from base)"
        )
        out.append(f"cut{i} as materialized (select list_slice(every, 1, len(every) - 1) as c from cuts{i})")
    binned = ", ".join(f"list_min(list_filter((select c from cut{i}), lambda v: v >= x{i})) as b{i}" for i in range(len(features)))
    out.append(f"binned as materialized (select key, y, h, {binned} from base)")
    one = f"select 0 as tree, key, 1 as id, 1 as w from binned"
    if bag:
        draws = []
        for t in range(trees):
            a, b = _factors(seed, t)
            u = f"((h % {PRIME}) * {a} + {b}) % {PRIME} / {float(PRIME)!r}"
            draws.append(f"select {t} as tree, key, 1 as id, " + " + ".join(f"({u} >= {float(p)!r})::int" for p in POISSON) + " as w from binned")
        one = " union all ".join(draws)
    out.append(f"at0 as materialized ({one})")
    for d in range(depth + 1):
        fresh = f"id >= {1 << d}"
        out.append(f"n{d} as materialized (select *, {_impurity(s, classes)} as imp from (select tree, id, count(*) as n, {', '.join(part)} from at{d} join binned using (key) where w > 0 and {fresh} group by tree, id))")
        if d == depth:
            break
        live = f"select tree, id from n{d} where n >= {min_split} and n >= {2 * min_leaf} and imp > {PURE}"
        cells = " union all ".join(f"select a.tree, a.id, {i} as f, b{i} as b, count(*) as n, {', '.join(part)} from at{d} a join ({live}) using (tree, id) join binned using (key) where w > 0 group by all" for i in range(len(features)))
        below, whole = "over (partition by tree, id, f order by b nulls last)", "over (partition by tree, id, f)"
        sides = ", ".join(f"sum({c}) {below} as l{c}, sum({c}) {whole} - sum({c}) {below} as r{c}" for c in ("n", *s))
        loss = " + ".join(f"({' + '.join(p + c for c in s) if classes else p + 's0'}) * {_impurity([p + c for c in s], classes)}" for p in ("l", "r"))
        if not classes:
            both = [f"(l{c} + r{c})" for c in s]
            loss = f"round(({loss}) / ({both[0]} * {_impurity(both, 0)}), 9)"
        out.append(
            f"best{d} as materialized (select tree, id, f, b from (select tree, id, f, b, {sides} from ({cells})) where b is not null and ln >= {min_leaf} and rn >= {min_leaf} "
            f"qualify row_number() over (partition by tree, id order by {loss}, f, b) = 1)"
        )
        side = "case " + " ".join(f"when f = {i} then b{i} <= b" for i in range(len(features))) + " end"
        out.append(f"at{d + 1} as materialized (select a.tree, a.key, case when f is null then a.id when coalesce({side}, false) then 2 * a.id else 2 * a.id + 1 end as id, a.w from at{d} a join binned using (key) left join best{d} using (tree, id))")
    cut = " union all ".join(f"select * from best{d}" for d in range(depth)) or "select null::int as tree, null::int as id, null::int as f, null::double as b"
    out.append(f"splits as materialized ({cut})")
    every = " union all ".join(f"select tree, id, {d} as depth, n, {', '.join(s)}, imp from n{d}" for d in range(depth + 1))
    says = "[" + ", ".join(f"coalesce({c} / nullif({weight}, 0), 0)" for c in s) + "]" if classes else "[coalesce(s1 / nullif(s0, 0), 0)]"
    out.append(f"nodes as materialized (select e.*, {weight} as weight, f as feature, b as threshold, {says} as says from ({every}) e left join splits using (tree, id))")
    return ", ".join(out)


def pruning(depth: int, alphas: Sequence[float]) -> str:
    """CTEs after ``growth`` up to ``ends`` (alpha, tree, id): the leaves that stay under each cost."""
    out = [f"alphas as (select unnest([{', '.join(map(str, alphas))}]::double[]) as alpha)"]
    out.append("priced as materialized (select alpha, tree, id, depth, feature is null as leaf, imp * weight / (select max(weight) from nodes r where r.tree = nodes.tree and r.id = 1) + alpha as own from nodes, alphas)")
    for d in range(depth, -1, -1):
        under = f"left join (select alpha, tree, id // 2 as id, sum(cost) as under from p{d + 1} group by all) using (alpha, tree, id)" if d < depth else "cross join (select null::double as under)"
        out.append(f"p{d} as materialized (select alpha, tree, id, leaf or (alpha > 0 and own <= under + 1e-15) as stop, case when leaf or (alpha > 0 and own <= under + 1e-15) then own else under end as cost from priced {under} where depth = {d})")
    out.append("stops as materialized (" + " union all ".join(f"select alpha, tree, id, {d} as depth from p{d} where stop" for d in range(depth + 1)) + ")")
    out.append("ends as materialized (select s.* from stops s where not exists (select 1 from stops t where t.alpha = s.alpha and t.tree = s.tree and t.depth < s.depth and s.id >> (s.depth - t.depth) = t.id))")
    return ", ".join(out)


def shapley(features: int) -> str:
    """CTEs after ``growth`` up to ``phi`` (key, f, phi) for a single regression tree, by listing every coalition."""
    return f"""steps as materialized (select l.id as leaf, l.says[1] as v, p.feature as f, p.threshold as thr, (l.id >> (l.depth - p.depth - 1)) & 1 = 0 as goes_left, c.weight / p.weight as share
        from nodes l join nodes p on p.depth < l.depth and l.id >> (l.depth - p.depth) = p.id join nodes c on c.id = l.id >> (l.depth - p.depth - 1) and c.depth = p.depth + 1 where l.feature is null),
    sets as (select unnest(range({1 << features})) as s),
    long as (select key, unnest(range({features})) as f, unnest([{', '.join(f'x{i}' for i in range(features))}]) as x from base),
    worth as materialized (select key, s, sum(v * p) as v from (select key, s, leaf, any_value(v) as v, product(case when (s >> steps.f) & 1 = 1 then ((x <= thr) = goes_left)::int else share end) as p
        from steps join long using (f) cross join sets group by key, s, leaf) group by key, s),
    phi as (select a.key, j as f, sum((b.v - a.v) * factorial(cast(bit_count(a.s) as int)) * factorial(cast({features} - 1 - bit_count(a.s) as int)) / factorial({features})) as phi
        from worth a cross join (select unnest(range({features})) as j) join worth b on b.key = a.key and b.s = a.s | (1 << j) where (a.s >> j) & 1 = 0 group by a.key, j)"""
