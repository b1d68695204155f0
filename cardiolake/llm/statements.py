"""DuckDB statements of the corpus queries that SQL can state."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def clustering(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """One step a round: every vector against every centroid, then exact floors of the means."""
    steps = [
        f"""v as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda e: cast(floor({scale} * cast(e as double)) as bigint)) as x
            from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda e: e is not null and isfinite(e))) = {dim})""",
        f"""c0 as materialized (select row_number() over (order by h, x) - 1 as j, x from
            (select sha256('{seed}:' || coalesce(cast(vec_id as varchar), '')) as h, x from v order by h, x limit {k}))""",
    ]
    for r in range(rounds + 1):
        apart = "list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
        steps.append(
            f"""a{r} as materialized (select r, any_value(vec_id) as vec_id, any_value(x) as x, min(struct_pack(d := d, j := j)) as n from
            (select v.r, v.vec_id, v.x, c.j, cast({apart} as bigint) as d from v cross join c{r} c) group by r)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} as materialized (select c.j, coalesce(m.x, c.x) as x from c{r} c left join
                (select j, list(cast(floor(s / n) as bigint) order by i) as x from
                    (select j, i, sum(x[i]) as s, count(*) as n from (select n.j as j, x, unnest(range(1, {dim} + 1)) as i from a{r}) group by j, i)
                 group by j) m on m.j = c.j)"""
            )
    final = f"a{rounds}"
    return f"""with {', '.join(steps)}
        select vec_id, cast(n.j as integer) as cluster, n.d as distance, cast(sum(n.d) over (partition by n.j) as bigint) as cluster_inertia,
            cast(sum(n.d) over () as bigint) as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256
        from {final} a join c{rounds} c on c.j = a.n.j"""


def resampling(percent: int = 10, least_words: int = 20, buckets: int = 10_000, seed: int = 2024) -> str:
    """crc32 goes by its table, made by its rule, once a distinct word."""
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""with crc as materialized (select list(list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) order by n) as t from range(256) r(n)),
        d as materialized (select row_number() over () as r, doc_id, {words} as w from documents),
        b as materialized (select {words} as w from benchmark),
        dw as (select r, unnest(w) as word from d),
        tw as (select unnest(w) as word from b),
        h as materialized (select word, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(word))), lambda i: cast(('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2]) as bigint))),
            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])) as c from (select word from dw union select word from tw) cross join crc),
        k as materialized (select word, xor(c, 4294967295) % {buckets} as bucket from h),
        s as (select bucket, count(*) as n from dw join k using (word) group by 1),
        t as (select bucket, count(*) as n from tw join k using (word) group by 1),
        z as (select (select count(*) from dw) as s, (select count(*) from tw) as t),
        g as materialized (select bucket, cast(floor(1000 * ln(cast(coalesce(t.n, 0) + 1 as double) * cast(z.s + {buckets} as double)
            / (cast(s.n + 1 as double) * cast(z.t + {buckets} as double)))) as bigint) as gain from s left join t using (bucket) cross join z),
        f as (select r, count(*) as n, sum(gain) as weight from dw join k using (word) join g using (bucket) group by r),
        e as (select d.r, doc_id, coalesce(f.n, 0) as n_features, cast(coalesce(weight, 0) as bigint) as weight,
            cast(('0x' || sha256('{seed}:' || coalesce(cast(doc_id as varchar), ''))[1:8]) as bigint) as h from d left join f on f.r = d.r),
        q as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from e),
        o as (select r, row_number() over (order by score desc, doc_id nulls last) as rank, count(*) over () as n from q where n_features >= {least_words})
        select doc_id, n_features, weight, score, case when rank <= n * {percent} // 100 then rank end as rank from q left join o on o.r = q.r"""


def jaccard(words: int = 5, percent: int = 80) -> str:
    """Every pair that shares a shingle is counted; components by reaching out along the links."""
    return f"""with recursive d as materialized (select row_number() over () as r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') as w from documents),
        s as materialized (select r, doc_id, list_distinct(case when len(w) >= {words} then list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
        u as materialized (select r, len(g) as n, unnest(g) as t from s),
        l as materialized (select a.r as a, b.r as b from u a join u b on a.t = b.t and a.r <> b.r and 100 * a.n >= {percent} * b.n and 100 * b.n >= {percent} * a.n
            group by a.r, b.r, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        reach(a, b) as (select r, r from s union select reach.a, l.b from reach join l on reach.b = l.a)
        select x.doc_id, len(x.g) as n_shingles, min(y.doc_id) as component_id from s x join reach on reach.a = x.r join s y on y.r = reach.b
        group by x.r, x.doc_id, x.g"""


STATEMENTS = {
    "op11_ns_bounds_clustering": clustering(),
    "op12_importance_resampling": resampling(),
    "op13_jaccard_join": jaccard(),
}
