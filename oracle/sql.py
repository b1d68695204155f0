"""DuckDB statements that state each query independently, over the same tables."""

from __future__ import annotations

# --- shared steps -----------------------------------------------------------------------

SIG = """
ev as (select event_type || '-' || cast(event_id // 100000 as varchar) as record_id, event_id, value from events),
b as (select record_id, row_number() over (partition by record_id order by event_id) - 1 as i,
             cast(floor(value) as bigint) as fv from ev),
s as (select record_id, i,
        sum(fv) over (partition by record_id order by i rows between 19 preceding and current row) as s20,
        i % 400 as p, cast(floor(i/400.0) as bigint) % 3 as c from b),
q as (select record_id, cast(i as bigint) as i,
        cast(130 as double) + cast(s20 as double)/cast(100 as double)
        - case when c=0 then greatest(cast(0 as double), cast(30 as double)-cast(0.375 as double)*abs(p-290))
               when c=1 then greatest(cast(0 as double), cast(45 as double)-cast(0.75 as double)*abs(p-290))
               else cast(0 as double) end as base, p from s),
sig as (select record_id, i,
  case when i%500 between 100 and 129 then null
       when i%500 between 400 and 449 then cast(0 as double)
       when i%211=7 then cast(400 as double)
       when i%173=11 then base+40
       else base end as fhr,
  cast(greatest(0, 60-abs(p-200)) as double) as uc
from q)"""


def clean_step(value: str, source: str, out: str) -> str:
    """Range rule, spike rule and gap rule for one column of ``source``."""
    return f"""
{out}_r as (select record_id, i, {value} as raw,
    case when {value} between 50 and 240 and {value} <> 0 then {value} end as r from {source}),
{out}_v as (select *, case when coalesce(abs(r - lag(r) over (partition by record_id order by i)) > 30, false)
    then null else r end as v from {out}_r),
{out}_g as (select *,
    last_value(case when v is not null then i end ignore nulls) over a as ib,
    first_value(case when v is not null then i end ignore nulls) over f as ia,
    last_value(v ignore nulls) over a as bv, first_value(v ignore nulls) over f as av,
    count(*) over (partition by record_id) as n
    from {out}_v
    window a as (partition by record_id order by i rows between unbounded preceding and current row),
           f as (partition by record_id order by i rows between current row and unbounded following)),
{out}_s as (select *, v is null and (coalesce(ia, n) - coalesce(ib, -1) - 1) <= 40
    and (ia is not null or ib is not null) as short from {out}_g),
{out} as (select record_id, i, n, raw, v is null as invalid, short as filled, v is null and not short as unfilled,
    case when v is not null then v
         when short and ib is not null and ia is not null then bv + (av - bv) / (ia - ib) * (i - ib)
         when short then coalesce(bv, av) end as x from {out}_s)"""


FHR = clean_step("fhr", "sig", "fc")
UC = clean_step("uc", "sig", "ucc")
CLEAN = f"{SIG},{FHR}"
CLEAN_BOTH = (
    f"{SIG},{FHR},{UC},\nclean as (select fc.record_id, fc.i, fc.n, fc.x as fhr, ucc.x as uc"
    " from fc join ucc on fc.record_id = ucc.record_id and fc.i = ucc.i)"
)
CLEAN_RAW_UC = (
    f"{SIG},{FHR},\nclean as (select fc.record_id, fc.i, fc.n, fc.x as fhr, sig.uc as uc"
    " from fc join sig on fc.record_id = sig.record_id and fc.i = sig.i)"
)

BASELINE = """
bl_starts as (select record_id, unnest(range(0, n - 480 + 1, 40)) as st from (select distinct record_id, n from fc)),
bl_win as (select w.record_id, w.st, max(x) - min(x) as rng, avg(x) as m, count(x) as nv
    from bl_starts w join fc on fc.record_id = w.record_id and fc.i >= w.st and fc.i < w.st + 480 group by 1, 2),
bl_best as (select * from (select *, row_number() over (partition by record_id order by rng, st) as rk
    from bl_win where nv >= 384 and rng < 25) where rk = 1),
bl_all as (select record_id, avg(x) as m, count(x) as nv, max(x) - min(x) as rng from fc group by 1),
bl_raw as (select a.record_id, b.st, b.rng as brng, a.rng as arng, a.nv,
    case when b.st is not null then round_even(b.m / 5, 0) * 5 when a.nv = 0 then 140.0
         else round_even(a.m / 5, 0) * 5 end as value
    from bl_all a left join bl_best b on a.record_id = b.record_id),
baseline as (select record_id, value, value between 110 and 160 as is_normal, value < 110 as is_bradycardia,
    value > 160 as is_tachycardia, st is not null as stable_segment_found, st as segment_start_idx,
    coalesce(brng, arng) as segment_variability,
    case when st is not null then 1.0 - brng / 25 when nv = 0 then 0.0 else 0.5 end as confidence from bl_raw)"""

VARIABILITY = """
va_starts as (select record_id, unnest(case when n < 240 then [cast(0 as bigint)] else range(0, n - 240 + 1, 120) end) as st
    from (select distinct record_id, n from fc)),
va_win as (select w.record_id, w.st, max(x) - min(x) as rng, count(x) as nv, any_value(n) as n
    from va_starts w join fc on fc.record_id = w.record_id and fc.i >= w.st and fc.i < w.st + 240 group by 1, 2),
va_ok as (select * from va_win where (n < 240 and nv > 0) or (n >= 240 and nv >= 120)),
va_agg as (select r.record_id, avg(rng) as m, min(rng) as lo, max(rng) as hi, count(rng) as nw
    from (select distinct record_id from fc) r left join va_ok v on v.record_id = r.record_id group by 1),
variability as (select record_id, case when nw > 0 then round_even(m, 1) else 0.0 end as value,
    case when nw = 0 then 'Unknown' when m <= 2 then 'Absent' when m <= 5 then 'Minimal' when m <= 25 then 'Moderate'
         else 'Marked' end as category,
    case when nw > 0 then round_even(lo, 1) else 0.0 end as min_value,
    case when nw > 0 then round_even(hi, 1) else 0.0 end as max_value, nw as n_windows from va_agg)"""

DECELS = """
de_low as (select fc.record_id, fc.i, c.fhr, b.value as base, fc.i - row_number() over (partition by fc.record_id order by fc.i) as g
    from fc join clean c on c.record_id = fc.record_id and c.i = fc.i
    join baseline b on b.record_id = fc.record_id where c.fhr < b.value - 15),
de_run as (select record_id, g, any_value(base) as base, min(i) as s, max(i) + 1 as e, min(fhr) as nv, max(fhr) as hv,
    arg_min(fhr, i) as fv, count(*) filter (fhr < 70) as below from de_low group by 1, 2 having count(*) >= 60),
de_nad as (select r.*, (select min(l.i) from de_low l where l.record_id = r.record_id and l.g = r.g and l.fhr = r.nv) as na from de_run r),
de_pk as (select r.record_id, r.s, max(coalesce(c.uc, 0)) as pu, count(c.uc) as present,
    count(*) filter (c.uc is null or c.uc <> 0) as notzero
    from de_nad r join clean c on c.record_id = r.record_id and c.i >= greatest(r.s - 480, 0) and c.i < r.s + 240 group by 1, 2),
de_pi as (select p.*, (select min(c.i) from clean c where c.record_id = p.record_id and c.i >= greatest(p.s - 480, 0)
    and c.i < p.s + 240 and coalesce(c.uc, 0) = p.pu) as pidx from de_pk p),
de_sh as (select r.record_id, r.s,
    max(c.fhr) filter (c.i >= r.e) as ahigh,
    min(c.fhr) filter (c.i < r.s + (r.e - r.s) // 2) as low1,
    min(c.fhr) filter (c.i >= r.s + (r.e - r.s) // 2 and c.i < r.e) as low2,
    max(c.fhr) filter (c.i >= r.s + (r.e - r.s) // 2 - 5 and c.i < r.s + (r.e - r.s) // 2 + 5) as midhigh
    from de_nad r join clean c on c.record_id = r.record_id and c.i >= r.s and c.i < r.e + 240 group by 1, 2),
de_m as (select r.*, p.present > 0 and p.notzero > 0 as has_uc, (r.na - p.pidx) / 4.0 as lag0, s2.ahigh, s2.low1, s2.low2, s2.midhigh,
    case when r.na > r.s then (r.fv - r.nv) / (r.na - r.s) else 0.0 end as rate, (r.e - r.na) / 4.0 as rec
    from de_nad r join de_pi p on p.record_id = r.record_id and p.s = r.s
    join de_sh s2 on s2.record_id = r.record_id and s2.s = r.s),
decels as (select record_id, s as start_idx, e as end_idx, na as nadir_idx, round_even(base - nv, 1) as depth,
    round_even((e - s) / 4.0, 1) as duration_seconds,
    case when (e - s) / 4.0 > 120 then 'Prolonged' when rate > 0.5 then 'Variable' when not has_uc then 'Unclassified'
         when abs(lag0) < 5 then 'Early' when lag0 > 15 then 'Late' when rate > 0.3 then 'Variable' else 'Unclassified' end as decel_type,
    round_even(case when has_uc then lag0 else 0.0 end, 1) as lag_seconds,
    concat_ws('; ', case when below / 4.0 > 60 then 'Severe drop (<70 bpm for >60s)' end,
        case when hv - nv < 5 then 'Absent internal variability' end,
        case when rec > 60 then 'Slow recovery (' || cast(cast(round_even(rec, 0) as bigint) as varchar) || 's)' end,
        case when ahigh > base + 10 then 'Overshoot' end,
        case when e - s > 20 and low1 < base - 10 and low2 < base - 10 and midhigh > low1 + 10 then 'W-shape (biphasic)' end) as signs,
    round_even(rate, 3) as descent_rate, round_even(nv, 1) as nadir_value from de_m)"""

COUNTS = """
counts as (select r.record_id, count(d.start_idx) as decel_count,
    count(*) filter (decel_type = 'Early') as early_count, count(*) filter (decel_type = 'Late') as late_count,
    count(*) filter (decel_type = 'Variable') as variable_count, count(*) filter (decel_type = 'Prolonged') as prolonged_count,
    count(*) filter (decel_type = 'Unclassified') as unclassified_count,
    count(*) filter (decel_type = 'Variable' and signs <> '') as severe_variable_count
    from (select distinct record_id from fc) r left join decels d on d.record_id = r.record_id group by 1)"""


def tachysystole_step(window: int, minutes: float) -> str:
    """Contraction peaks and rate of the last ``window`` samples of ``clean``."""
    return f"""
ta_u as (select record_id, i - greatest(n - {window}, 0) as i, n, coalesce(uc, 0.0) as u from clean where i >= n - {window}),
ta_f as (select record_id, any_value(n) as n, stddev_pop(u) as sd, quantile_cont(u, 0.75) as p75, max(abs(u)) as big, max(i) as li
    from ta_u group by 1),
ta_c as (select * from (select record_id, i, u, u > lag(u) over w as rise, lag(u) over w as pu from ta_u
    window w as (partition by record_id order by i)) where u <> pu),
ta_n as (select *, lead(i) over w as ni, lead(rise) over w as nr from ta_c window w as (partition by record_id order by i)),
ta_p as (select t.record_id, (t.i + t.ni - 1) // 2 as p, t.u as h from ta_n t join ta_f f on f.record_id = t.record_id
    where t.rise and not t.nr and f.big > 0 and f.sd >= 1e-6 and t.u >= f.p75),
ta_o as (select record_id, list(struct_pack(q := -h, p := -p) order by -h, -p) as l from ta_p group by 1),
ta_k as (select record_id, unnest(list_reduce(l, lambda acc, e: case when len(list_filter(acc, lambda k: abs(k.p - e.p) < 240)) > 0
    then acc else list_append(acc, e) end, [l[1]])) as k from ta_o),
ta_s as (select record_id, -k.p as p, -k.q as h from ta_k),
ta_b as (select s.record_id, s.p, s.h, max(u.i) filter (u.i < s.p and u.u > s.h) as lb, min(u.i) filter (u.i > s.p and u.u > s.h) as rb
    from ta_s s join ta_u u on u.record_id = s.record_id group by 1, 2, 3),
ta_m as (select b.record_id, b.p, b.h, min(u.u) filter (u.i <= b.p) as lm, min(u.u) filter (u.i >= b.p) as rm
    from ta_b b join ta_u u on u.record_id = b.record_id and u.i > coalesce(b.lb, -1) and (b.rb is null or u.i < b.rb) group by 1, 2, 3),
ta_a as (select m.* from ta_m m join ta_f f on f.record_id = m.record_id where m.h - greatest(m.lm, m.rm) >= 0.5 * f.sd),
ta_r as (select f.*, coalesce(a.total, 0) as total, coalesce(a.idx, '') as idx, f.big = 0 or f.sd < 1e-6 as flat,
    case when f.n < {window} then f.n / 4.0 / 60 else {minutes} end as mins
    from ta_f f left join (select record_id, count(*) as total, string_agg(cast(p as varchar), ',' order by p) as idx from ta_a group by 1) a
    on a.record_id = f.record_id),
tachy as (select record_id, not flat and total / (mins / 10.0) > 5 as detected,
    case when flat then 0.0 else round_even(total / (mins / 10.0), 1) end as contractions_per_10min,
    total as total_contractions, case when flat then mins else round_even(mins, 1) end as analysis_duration_minutes,
    idx as contraction_indices, case when flat then 0.0 else round_even(least(1.0, sd / 20), 2) end as confidence from ta_r)"""


def sinusoidal_step(window: int, minutes: float) -> str:
    """Direct Fourier sums over the last ``window`` samples of ``fc``."""
    return f"""
si_t as (select record_id, i - (n - {window}) as k, n, x from fc where n >= {window} and i >= n - {window}),
si_f as (select record_id, any_value(n) as n, count(x) filter (i >= n - {window}) as nv,
    max(x) filter (i >= n - {window}) - min(x) filter (i >= n - {window}) as amp,
    avg(x) filter (i >= n - {window}) as m from fc group by 1),
si_d as (select t.record_id, t.k, coalesce(t.x, f.m) - f.m as y from si_t t join si_f f on f.record_id = t.record_id
    where f.nv >= {window} * 0.5),
si_w as (select k as a, cos(2 * pi() * k / {window}) as c, sin(2 * pi() * k / {window}) as s from range({window}) r(k)),
si_b as (select unnest(range(1, ({window} + 1) // 2)) as b),
si_m as (select d.record_id, b.b, sqrt(sum(d.y * w.c) ** 2 + sum(d.y * w.s) ** 2) as mag
    from si_d d cross join si_b b join si_w w on w.a = (d.k * b.b) % {window} group by 1, 2),
si_q as (select *, b * (1.0::double / ({window} * 0.25::double)) as fr from si_m),
si_i as (select record_id, arg_max(fr, struct_pack(m := mag, nb := -b)) as fr, sum(mag) as inband
    from si_q where fr >= 3.0::double / 60 and fr <= 5.0::double / 60 group by 1),
si_a as (select i.record_id, i.fr, i.inband / (select sum(mag) from si_q q where q.record_id = i.record_id) as dom from si_i i),
si_r as (select f.*, a.fr, a.dom, a.fr is not null as seen, f.amp between 5 and 15 as fit from si_f f left join si_a a on a.record_id = f.record_id),
sinus as (select record_id, coalesce(seen and fit and dom >= 0.3, false) as detected,
    case when seen then round_even(greatest(0.0, least(1.0, 0.6 * least(1.0, dom / 0.6) + 0.4 * greatest(0.0, 1 - abs(amp - 10) / 5))), 2)
         when n >= {window} and nv < {window} * 0.5 then 0.2 else 0.0 end as confidence,
    round_even(fr, 4) as dominant_frequency, round_even(fr * 60, 1) as frequency_cycles_per_min,
    case when seen then round_even(amp, 1) else 0.0 end as amplitude, coalesce(seen and fit, false) as amplitude_in_range,
    case when seen then round_even(dom, 3) else 0.0 end as dominance_ratio,
    case when n < {window} then n / 4.0 / 60 else {minutes} end as analysis_duration_minutes from si_r)"""
