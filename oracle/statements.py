"""One DuckDB statement per catalog query that SQL can state."""

from __future__ import annotations

from oracle.sql import (
    BASELINE,
    CLEAN,
    CLEAN_BOTH,
    CLEAN_RAW_UC,
    COUNTS,
    DECELS,
    SIG,
    VARIABILITY,
    clean_step,
    sinusoidal_step,
    tachysystole_step,
)


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) as {c.split('.')[-1]}" for c in columns)


def sql_list(d: dict, key: str, default: str) -> str:
    whens = " ".join(f"when {key} = {k} then '{v}'" for k, v in d.items())
    return f"case {whens} else {default} end"


# --- derived inputs -----------------------------------------------------------------------

FINDINGS = """
fi as (select o_orderkey as record_id, 95.0::double + (o_custkey % 17) * 5 as baseline,
    (['Absent', 'Minimal', 'Moderate', 'Marked', 'Unknown'])[(o_orderkey + o_custkey) % 5 + 1] as variability_category,
    (o_orderkey * 7 % 300) / 10.0::double as variability_value, o_custkey % 5 as late_count, (o_orderkey + 1) % 6 as variable_count,
    (o_orderkey % 3) * case when (o_orderkey + 1) % 6 > 0 then 1 else 0 end as severe_variable_count,
    case when o_custkey % 7 = 0 then 2 else 0 end as prolonged_count, o_custkey % 3 as early_count,
    o_orderkey % 4 = 0 as tachysystole, (o_orderkey * 3 % 90) / 10.0::double as contraction_rate,
    (o_orderkey + o_custkey) % 11 = 0 as sinusoidal, cast(o_orderkey % 3 as integer) as ml_prediction,
    (o_custkey % 101) / 100.0::double as confidence from orders),
fx as (select *, late_count + variable_count + prolonged_count + early_count as decel_count, baseline < 110 as is_bradycardia from fi)"""

LABELLED = """
lb as (select cast(vec_id % 7 as varchar) as record_id, vec_id as w, cast(label % 3 as integer) as label,
    cast(case when vec_id % 4 = 0 then (label + vec_id) % 3 else label % 3 end as integer) as prediction from embeddings)"""

HEADERS = """
hd as (select cast(o_orderkey as varchar) as record_id, o_orderkey as k, o_custkey as c, 14400 + o_custkey % 7221 as n,
    case when o_orderkey % 10 in (0, 1, 2) then null else cast('7.' || lpad(cast((o_custkey * 37 + o_orderkey) % 60 as varchar), 2, '0') as double) end as ph,
    o_orderkey % 97 = 5 as bad_line, o_orderkey % 89 = 7 as no_fhr from orders)"""


def cells_report(source: str) -> str:
    return f"""
cc as (select label, prediction, count(*) as n from {source} group by 1, 2),
cl as (select label as c from cc union select prediction from cc),
pc as (select c, coalesce((select sum(n) from cc where label = c and prediction = c), 0) as hit,
    coalesce((select sum(n) from cc where label = c), 0) as support, coalesce((select sum(n) from cc where prediction = c), 0) as predicted from cl),
pm as (select c, hit, support, case when predicted > 0 then hit / predicted::double else 0.0::double end as precision,
    case when support > 0 then hit / support::double else 0.0::double end as recall,
    case when support + predicted > 0 then 2 * hit / (support + predicted)::double else 0.0::double end as f1 from pc)"""


REPORT_TAIL = """
select cast(c as varchar) as row, round(precision, 3) as precision, round(recall, 3) as recall, round(f1, 3) as f1, cast(support as bigint) as support from pm
union all select 'accuracy', round(sum(hit) / sum(support)::double, 3), round(sum(hit) / sum(support)::double, 3), round(sum(hit) / sum(support)::double, 3), cast(sum(support) as bigint) from pm
union all select 'macro avg', round(avg(precision), 3), round(avg(recall), 3), round(avg(f1), 3), cast(sum(support) as bigint) from pm
union all select 'weighted avg', round(sum(precision * support) / sum(support), 3), round(sum(recall * support) / sum(support), 3), round(sum(f1 * support) / sum(support), 3), cast(sum(support) as bigint) from pm"""


def interpolation(pick: str) -> str:
    return f"""with {SIG},
ra as (select record_id, i, case when fhr between 50 and 240 and fhr <> 0 then fhr end as x from sig),
nb as (select *, last_value(case when x is not null then i end ignore nulls) over a as ib,
    first_value(case when x is not null then i end ignore nulls) over f as ia,
    last_value(x ignore nulls) over a as bv, first_value(x ignore nulls) over f as av from ra
    window a as (partition by record_id order by i rows between unbounded preceding and current row),
           f as (partition by record_id order by i rows between current row and unbounded following))
select record_id, i, round(case when x is not null then x when ib is null then av when ia is null then bv else {pick} end, 6) as fhr,
    x is null as fhr_was_missing from nb"""


def changes_peaks(source: str) -> str:
    """Local maxima of ``source(record_id, i, u)``; plateaus count at their middle."""
    return f"""
pk_c as (select * from (select record_id, i, u, u > lag(u) over w as rise, lag(u) over w as pu from {source}
    window w as (partition by record_id order by i)) where u <> pu),
pk_n as (select *, lead(i) over w as ni, lead(rise) over w as nr from pk_c window w as (partition by record_id order by i)),
pk as (select record_id, (i + ni - 1) // 2 as p, u as h from pk_n where rise and not nr)"""


def spaced_peaks(source: str, out: str) -> str:
    return f"""
{out}_o as (select record_id, list(struct_pack(q := -h, p := -p) order by -h, -p) as l from {source} group by 1),
{out}_k as (select record_id, unnest(list_reduce(l, lambda acc, e: case when len(list_filter(acc, lambda k: abs(k.p - e.p) < 240)) > 0
    then acc else list_append(acc, e) end, [l[1]])) as k from {out}_o),
{out} as (select record_id, -k.p as p, -k.q as h from {out}_k)"""


BOUNDS = """
wn as (select record_id, count(*) as n from sig group by 1),
ws as (select record_id, n, unnest(case when n < 480 then [cast(0 as bigint)] else range(0, n - 480 + 1, 120) end) as st from wn),
wb as (select record_id, st // 120 as w, st as start_idx, least(st + 480, n) as end_idx, st / 4.0::double as start_sec,
    least(st + 480, n) / 4.0::double as end_sec from ws)"""

RULES = f"{CLEAN_BOTH},{BASELINE},{VARIABILITY},{DECELS},{COUNTS},{tachysystole_step(7200, 30.0)},{sinusoidal_step(4800, 20.0)}"
RULES_RAW = f"{CLEAN_RAW_UC},{BASELINE},{VARIABILITY},{DECELS},{COUNTS},{tachysystole_step(7200, 30.0)},{sinusoidal_step(1200, 5.0)}"

ALL_FINDINGS = """
fx as (select b.record_id, b.value as baseline, b.is_normal, b.is_bradycardia, b.is_tachycardia, b.stable_segment_found,
    b.confidence as baseline_confidence, v.value as variability_value, v.category as variability_category, v.n_windows as variability_windows,
    c.* exclude (record_id), t.detected as tachysystole, t.contractions_per_10min as contraction_rate,
    cast(t.total_contractions as integer) as total_contractions, s.detected as sinusoidal, s.confidence as sinusoidal_confidence
    from baseline b join variability v using (record_id) join counts c using (record_id) join tachy t using (record_id) join sinus s using (record_id))"""



def window_rules(window: int, step: int, wave: int, wave_minutes: float) -> str:
    """The record rules over the samples of each window, as if every window were a record."""
    return f"""with {SIG},{clean_step("fhr", "sig", "hc")},
wn as (select record_id, count(*) as n from sig group by 1),
ws as (select record_id, n, unnest(case when n < {window} then [cast(0 as bigint)] else range(0, n - {window} + 1, {step}) end) as st from wn),
wb as (select record_id, st // {step} as w, st as start_idx, least(st + {window}, n) as end_idx, record_id || '#' || cast(st // {step} as varchar) as k from ws),
fc as materialized (select wb.k as record_id, hc.i - wb.start_idx as i, wb.end_idx - wb.start_idx as n, hc.x from wb join hc on hc.record_id = wb.record_id and hc.i >= wb.start_idx and hc.i < wb.end_idx),
clean as materialized (select fc.record_id, fc.i, fc.n, fc.x as fhr, sig.uc from fc join wb on wb.k = fc.record_id join sig on sig.record_id = wb.record_id and sig.i = fc.i + wb.start_idx),
{BASELINE},{VARIABILITY},{DECELS},{COUNTS},{tachysystole_step(7200, 30.0)},{sinusoidal_step(wave, wave_minutes)},{ALL_FINDINGS}
select wb.record_id, wb.w, wb.start_idx, wb.end_idx, fx.* exclude (record_id) replace (round(baseline_confidence, 6) as baseline_confidence) from fx join wb on wb.k = fx.record_id"""


OVERRIDE = """
ov as (select *, lower(variability_category) = 'absent' as absent,
    concat_ws(' and ', case when late_count >= 3 then 'recurrent late decelerations' end,
        case when variable_count >= 3 then 'recurrent variable decelerations' end, case when baseline < 110 then 'bradycardia' end) as found from fx),
od as (select *, case when sinusoidal then 1 when absent and found <> '' then 2 when absent and ml_prediction = 0 then 3 else 4 end as rule from ov),
dc as (select *, rule < 4 as should_override, cast(case when rule < 3 then 2 when rule = 3 then 1 else ml_prediction end as integer) as final_category from od)"""

ALERT = """
al as (select *, final_category + 1 as category, upper(variability_category) as vc from dc),
af as (select *, concat_ws(' | ',
    case when baseline < 110 then printf('ברדיקרדיה - קצב בסיסי %.0f bpm', baseline) when baseline > 160 then printf('טכיקרדיה - קצב בסיסי %.0f bpm', baseline)
         else printf('קצב בסיסי תקין: %.0f bpm', baseline) end,
    case vc when 'ABSENT' then printf('היעדר שונות (%.1f bpm) - ממצא חמור!', variability_value)
         when 'MINIMAL' then printf('שונות מזערית (%.1f bpm) - דורש מעקב', variability_value)
         when 'MODERATE' then printf('שונות תקינה (%.1f bpm)', variability_value) when 'MARKED' then printf('שונות מוגברת (%.1f bpm)', variability_value)
         else printf('שונות: %.1f bpm (%s)', variability_value, variability_category) end,
    case when late_count > 0 then printf('זוהו %d האטות מאוחרות', late_count) end,
    case when variable_count > 0 and severe_variable_count > 0 then printf('זוהו %d האטות משתנות (%d עם סימני חומרה)', variable_count, severe_variable_count)
         when variable_count > 0 then printf('זוהו %d האטות משתנות', variable_count) end,
    case when prolonged_count > 0 then printf('זוהו %d האטות ממושכות', prolonged_count) end,
    case when early_count > 0 then printf('זוהו %d האטות מוקדמות (בד"כ שפירות)', early_count) end,
    case when tachysystole then printf('Tachysystole - %.1f צירים/10 דקות', contraction_rate) end,
    case when sinusoidal then 'זוהתה תבנית סינוסואידלית - ממצא חמור!' end) as findings from al),
alert as (select record_id, category, confidence,
    case category when 3 then 'התראה אדומה - קטגוריה 3 (פתולוגי)' when 2 then 'התראה כתומה - קטגוריה 2 (ביניים)' else 'סטטוס ירוק - קטגוריה 1 (תקין)' end as headline,
    case when category = 3 and sinusoidal then 'זוהתה תבנית סינוסואידלית - מצב זה מחייב הערכה דחופה. תבנית סינוסואידלית אמיתית קשורה לאנמיה עוברית חמורה או לאסון רפואי מתקרב. יש להתייעץ עם רופא בכיר באופן מיידי.'
         when category = 3 and vc = 'ABSENT' then 'זוהה היעדר שונות בשילוב עם ממצאים מדאיגים נוספים. היעדר שונות מעיד על חוסר יכולת העובר להגיב לשינויים - מצב המעיד על מצוקה. נדרשת הערכה מיידית ושקילת התערבות.'
         when category = 3 then 'שילוב הממצאים מעיד על מצב פתולוגי הדורש התערבות מיידית. יש לבצע הערכה דחופה של מצב היולדת והעובר.'
         when category = 2 and contains(findings, 'האטות') then 'זוהו שינויים בדופק העובר הדורשים מעקב צמוד. השילוב של שינויים בשונות עם האטות מחייב ערנות מוגברת. יש להמשיך במעקב ולשקול התערבויות שמרניות.'
         when category = 2 then 'השונות אינה בטווח התקין. יש להמשיך לעקוב ולהעריך שינויים לאורך זמן.'
         else 'כל הפרמטרים בטווח התקין.' end as explanation,
    findings,
    case category when 3 then 'הערכה מיידית של הסיבות האפשריות | שקילת החייאה תוך-רחמית | היערכות ליילוד מיידי אם אין שיפור'
        when 2 then 'המשך ניטור צמוד | שינוי תנוחת היולדת | בדיקת לחץ דם והתייבשות' else 'המשך ניטור שגרתי' end as recommendations,
    case category when 3 then 'red' when 2 then 'orange' else 'green' end as color from af)"""

RULE_CLASS = """cast(case when sinusoidal then 2 when variability_category = 'Absent' and (late_count > 0 or is_bradycardia) then 2
    when variability_category in ('Minimal', 'Marked') then 1 when late_count > 0 then 1 else 0 end as integer)"""

SIGNALS_OF = "select record_id, start_idx, end_idx, nadir_idx, depth, duration_seconds, decel_type, lag_seconds, signs <> '' as has_severity_signs, signs as severity_signs, descent_rate, nadir_value from decels"

TACHY = f"select record_id, detected, {r6('contractions_per_10min')}, cast(total_contractions as integer) as total_contractions, {r6('analysis_duration_minutes')}, contraction_indices, confidence from tachy"

SINUS = f"select record_id, detected, confidence, {r6('dominant_frequency', 'frequency_cycles_per_min', 'amplitude')}, amplitude_in_range, {r6('dominance_ratio', 'analysis_duration_minutes')} from sinus"

PREPARED = f"""with {CLEAN},
{BOUNDS},
pv as (select b.record_id, b.w, avg(x) as pad from wb b join fc on fc.record_id = b.record_id and fc.i >= b.start_idx and fc.i < b.end_idx group by 1, 2),
pr as (select b.record_id, b.w, b.start_idx, b.end_idx, r.k, case when b.start_idx + r.k < b.end_idx then coalesce(fc.x, 0.0) else coalesce(pv.pad, 0.0) end as x
    from wb b cross join range(480) r(k) join pv on pv.record_id = b.record_id and pv.w = b.w
    left join fc on fc.record_id = b.record_id and fc.i = b.start_idx + r.k and fc.i < b.end_idx),
pz as (select record_id, w, start_idx, end_idx, avg(x) as m, stddev_pop(x) as s, min(x) as lo, max(x) as hi, count(*) as width from pr group by 1, 2, 3, 4)
select record_id, w, start_idx, end_idx, round(m, 8) as window_mean, round(s, 8) as window_std,
    round(case when s > 1e-8 then (lo - m) / s else lo - m end, 3) as z_min, round(case when s > 1e-8 then (hi - m) / s else hi - m end, 3) as z_max,
    cast(width as integer) as width from pz"""

# Whether the first sample of a window lies above the window's mean (missing ones count as zero).
STARTS = """
pz as (select b.record_id, b.w, b.start_idx, b.end_idx, arg_min(coalesce(fc.x, 0.0), fc.i) as first_x, sum(coalesce(fc.x, 0.0)) as total, avg(fc.x) as pad, count(*) as n
    from wb b join fc on fc.record_id = b.record_id and fc.i >= b.start_idx and fc.i < b.end_idx group by 1, 2, 3, 4),
ps as (select record_id, w, start_idx, end_idx, first_x > (total + (480 - n) * coalesce(pad, 0.0)) / 480 as high from pz)"""

PER_WINDOW = f"""with {CLEAN},
{BOUNDS},
pwf as (select b.record_id, b.w, fc.i - b.start_idx as i, b.end_idx - b.start_idx as n, fc.x from wb b join fc on fc.record_id = b.record_id and fc.i >= b.start_idx and fc.i < b.end_idx),
ps as (select record_id, w, n, unnest(range(0, n - 240 + 1, 40)) as st from (select distinct record_id, w, n from pwf)),
pw as (select s.record_id, s.w, s.st, max(x) - min(x) as rng, avg(x) as m, count(x) as nv from ps s join pwf f on f.record_id = s.record_id and f.w = s.w and f.i >= s.st and f.i < s.st + 240 group by 1, 2, 3),
pb as (select * from (select *, row_number() over (partition by record_id, w order by rng, st) as rk from pw where nv >= 192 and rng < 25) where rk = 1),
pa as (select record_id, w, any_value(n) as n, avg(x) as m, count(x) as nv, max(x) - min(x) as rng from pwf group by 1, 2),
pbase as (select a.record_id, a.w, case when b.st is not null then round_even(b.m / 5, 0) * 5 when a.nv = 0 then 140.0 else round_even(a.m / 5, 0) * 5 end as baseline,
    b.st is not null as stable_segment_found from pa a left join pb b using (record_id, w)),
vs as (select record_id, w, n, unnest(case when n < 240 then [cast(0 as bigint)] else range(0, n - 240 + 1, 120) end) as st from (select distinct record_id, w, n from pwf)),
vw as (select s.record_id, s.w, s.st, any_value(s.n) as n, max(x) - min(x) as rng, count(x) as nv from vs s join pwf f on f.record_id = s.record_id and f.w = s.w and f.i >= s.st and f.i < s.st + 240 group by 1, 2, 3),
va as (select a.record_id, a.w, avg(v.rng) as m from pa a left join (select * from vw where (n < 240 and nv > 0) or (n >= 240 and nv >= 120)) v using (record_id, w) group by 1, 2),
dl as (select f.record_id, f.w, f.i - row_number() over (partition by f.record_id, f.w order by f.i) as g from pwf f join pbase b using (record_id, w) where f.x < b.baseline - 15),
dd as (select record_id, w, count(*) as c from (select record_id, w, g from dl group by 1, 2, 3 having count(*) >= 60) group by 1, 2)
select b.record_id, b.w, b.baseline, b.stable_segment_found, case when v.m is null then 0.0 else round_even(v.m, 1) end as variability,
    case when v.m is null then 'Unknown' when v.m <= 2 then 'Absent' when v.m <= 5 then 'Minimal' when v.m <= 25 then 'Moderate' else 'Marked' end as category,
    coalesce(d.c, 0) as decel_count from pbase b join va v using (record_id, w) left join dd d using (record_id, w)"""

RULE_FEATURES = """round(baseline / 160.0, 6) as baseline_norm, round(variability_value / 25.0, 6) as variability_value_norm,
    case when variability_category = 'Absent' then 1.0::double else 0.0::double end as var_cat_absent, case when variability_category = 'Minimal' then 1.0::double else 0.0::double end as var_cat_minimal,
    case when variability_category = 'Moderate' then 1.0::double else 0.0::double end as var_cat_moderate, case when variability_category = 'Marked' then 1.0::double else 0.0::double end as var_cat_marked,
    round(late_count / 10.0::double, 6) as late_decel_count_norm, round(variable_count / 10.0::double, 6) as variable_decel_count_norm,
    {recurrent} as recurrent_decels_flag, case when tachysystole then 1.0::double else 0.0::double end as tachysystole_flag, case when sinusoidal then 1.0::double else 0.0::double end as sinusoidal_flag"""

FULL_SERIES_U = """
cu as (select record_id, i, n, coalesce(uc, 0.0) as u from clean where i >= n - cast(floor(n / 4.0::double / 60 * 60 * 4.0::double) as bigint)),
cf as (select record_id, stddev_pop(u) as sd, quantile_cont(u, 0.75) as p75, max(abs(u)) as big from cu group by 1)"""

CONTRACTION_COUNT = f"""with {CLEAN_RAW_UC},{FULL_SERIES_U},{changes_peaks('cu')},
hp as (select pk.* from pk join cf f on f.record_id = pk.record_id where f.big > 0 and f.sd >= 1e-6 and pk.h >= f.p75),
{spaced_peaks('hp', 'sp')},
ed as (select s.record_id, s.p, s.h, max(u.i) filter (u.i < s.p and u.u > s.h) as lb, min(u.i) filter (u.i > s.p and u.u > s.h) as rb from sp s join cu u on u.record_id = s.record_id group by 1, 2, 3),
bs as (select e.record_id, e.p, e.h, min(u.u) filter (u.i <= e.p) as lm, min(u.u) filter (u.i >= e.p) as rm from ed e join cu u on u.record_id = e.record_id
    and u.i > coalesce(e.lb, -1) and (e.rb is null or u.i < e.rb) group by 1, 2, 3),
ok as (select b.record_id, count(*) as c from bs b join cf f on f.record_id = b.record_id where b.h - greatest(b.lm, b.rm) >= 0.5 * f.sd group by 1)
select r.record_id, coalesce(ok.c, 0) as total_contractions from (select distinct record_id from clean) r left join ok on ok.record_id = r.record_id"""

STATEMENTS: dict[str, str] = {
    "record_table": f"with {SIG} select record_id, i / 4.0::double as timestamp, fhr as fhr1, uc from sig",
    "record_lengths": f"with {SIG} select record_id, count(*) as n_samples, count(*) / 4.0::double as duration_seconds, max(i) / 4.0::double as last_time from sig group by 1",
    "range_rule": f"with {CLEAN} select record_id, i, r as fhr from fc_r",
    "spike_flags": f"with {CLEAN} select record_id, i, r is not null and v is null as spike from fc_v",
    "gap_runs": f"""with {CLEAN}, gi as (select record_id, i, i - row_number() over (partition by record_id order by i) as g from fc where invalid)
        select record_id, min(i) as start_idx, max(i) + 1 as end_idx, count(*) as n_samples, count(*) <= 40 as fillable from gi group by record_id, g""",
    "clean_signal": f"with {CLEAN} select record_id, i, round(x, 6) as fhr, invalid as fhr_invalid, filled as fhr_filled, unfilled as fhr_unfilled from fc",
    "clean_smoothed": f"with {CLEAN} select record_id, i, round(median(x) over (partition by record_id order by i rows between 2 preceding and 2 following), 6) as fhr from fc",
    "clean_statistics": f"""with {CLEAN} select record_id, count(*) as total_samples, count(*) / 4.0::double as duration_seconds, count(*) filter (invalid) as invalid_samples,
        round(count(*) filter (invalid) / count(*)::double * 100, 6) as invalid_percent, count(*) filter (filled) as filled_samples,
        round(count(*) filter (filled) / count(*)::double * 100, 6) as filled_percent, count(*) - count(x) as remaining_missing,
        round((count(*) - count(x)) / count(*)::double * 100, 6) as remaining_missing_percent, round(coalesce(avg(x), 0), 6) as mean_value,
        round(coalesce(stddev_pop(x), 0), 6) as std_value from fc group by 1""",
    "interpolate_linear": interpolation("(av - bv) / (ia - ib) * (i - ib) + bv"),
    "interpolate_nearest": interpolation("case when i - ib <= ia - i then bv else av end"),
    "signal_summary": f"""with {SIG} select record_id, count(*) as n_samples, round(count(fhr) / count(*)::double, 6) as valid_ratio, round(coalesce(avg(fhr), 0), 6) as safe_mean,
        round(case when count(fhr) >= 2 then stddev_pop(fhr) else 0 end, 6) as safe_std,
        round(count(*) filter (fhr between 50 and 250) / count(*)::double, 6) as quality from sig group by 1""",
    "safe_median": f"with {SIG} select record_id, round(coalesce(median(fhr), 0), 6) as safe_median from sig group by 1",
    "fill_with_mean": f"with {SIG} select record_id, i, round(coalesce(fhr, avg(fhr) over (partition by record_id)), 6) as fhr from sig",
    "signal_quality_profile": f"""with {CLEAN} , pf as (select s.record_id, s.fhr, s.uc, case when s.fhr <> 0 then s.fhr end as lv, v.r is not null and v.v is null as sp
            from sig s join fc_v v on v.record_id = s.record_id and v.i = s.i)
        select record_id, round(count(*) / 240.0::double, 6) as duration_min, round((count(*) - count(lv)) / count(*)::double * 100, 6) as fhr_missing_pct, round(avg(lv), 6) as fhr_mean,
        round(stddev_pop(lv), 6) as fhr_std, round(min(lv), 6) as fhr_min, round(max(lv), 6) as fhr_max, count(*) filter (fhr = 0) as fhr_zeros, count(*) filter (fhr < 50 or fhr > 240) as fhr_artifacts,
        round((count(*) - count(uc)) / count(*)::double * 100, 6) as uc_missing_pct, round(avg(uc), 6) as uc_mean, round(stddev_pop(uc), 6) as uc_std, min(uc) as uc_min, max(uc) as uc_max,
        count(*) filter (uc = 0) as uc_zeros, count(*) filter (uc < 0) as uc_artifacts, count(*) filter (sp) as fhr_spikes, round(median(lv), 6) as fhr_median, round(median(uc), 6) as uc_median from pf group by 1""",
    "sliding_window_bounds": f"with {SIG},{BOUNDS} select * from wb",
    "stable_windows": f"with {CLEAN},{BASELINE} select record_id, st as start_idx, round(rng, 6) as range, round(m, 6) as mean from bl_win where nv >= 384 and rng < 25",
    "baseline_per_record": f"with {CLEAN},{BASELINE} select record_id, value, is_normal, is_bradycardia, is_tachycardia, stable_segment_found, segment_start_idx, {r6('segment_variability', 'confidence')} from baseline",
    "rounding_and_classes": """with pt as (select p_partkey, round_even(p_retailprice / 8 / 5, 0) * 5 as rounded, p_size / 2.0::double as s from part)
        select p_partkey, rounded, rounded between 110 and 160 as is_normal, rounded < 110 as is_bradycardia, rounded > 160 as is_tachycardia,
        case when s <= 2 then 'Absent' when s <= 5 then 'Minimal' when s <= 25 then 'Moderate' else 'Marked' end as variability from pt""",
    "variability_window_values": f"with {CLEAN},{VARIABILITY} select record_id, st as start_idx, round(rng, 6) as window_value from va_ok",
    "variability_per_record": f"with {CLEAN},{VARIABILITY} select record_id, value, category, category = 'Moderate' as is_normal, category in ('Absent', 'Minimal', 'Unknown') as is_concerning, min_value, max_value, n_windows from variability",
    "variability_quarter_overlap": f"with {CLEAN},{VARIABILITY.replace('- 240 + 1, 120)', '- 240 + 1, 180)')} select record_id, value, category, category = 'Moderate' as is_normal, category in ('Absent', 'Minimal', 'Unknown') as is_concerning, min_value, max_value, n_windows from variability",
    "baseline_seven_second_step": f"with {CLEAN},{BASELINE.replace('- 480 + 1, 40)', '- 480 + 1, 28)')} select record_id, value, is_normal, is_bradycardia, is_tachycardia, stable_segment_found, segment_start_idx, {r6('segment_variability', 'confidence')} from baseline",
    "runs_below_baseline": f"with {CLEAN_BOTH},{BASELINE},{DECELS} select record_id, s as start_idx, e as end_idx from de_run",
    "deceleration_events": f"with {CLEAN_BOTH},{BASELINE},{DECELS} {SIGNALS_OF}",
    "deceleration_events_raw_uc": f"with {CLEAN_RAW_UC},{BASELINE},{DECELS} {SIGNALS_OF}",
    "deceleration_counts": f"with {CLEAN_BOTH},{BASELINE},{DECELS},{COUNTS} select * from counts",
    "recurrence_rules": f"""with {FINDINGS} select record_id, early_count > 0 and late_count / early_count::double >= 0.5 as recurrent_share,
        early_count > 0 and decel_count / early_count::double > 0.5 as recurrent_for_features, late_count >= 3 as recurrent_late, variable_count >= 3 as recurrent_variable from fx""",
    "tail_segments": f"""with {SIG}, tn as (select *, count(*) over (partition by record_id) as n from sig)
        select record_id, any_value(n) as n, min(i) as first_idx, count(*) as rows, sum(uc) as uc_sum, max(i - greatest(n - 1200, 0)) as last_k from tn where i >= n - 1200 group by 1""",
    "local_maxima": f"with {CLEAN}, zu as (select record_id, i, coalesce(x, 0.0) as u from fc),{changes_peaks('zu')} select record_id, p, round(h, 6) as h from pk",
    "uc_upper_quartile": f"with {SIG} select record_id, round(quantile_cont(uc, 0.75), 6) as p75 from sig group by 1",
    "contraction_peaks": f"with {CLEAN_RAW_UC},{tachysystole_step(7200, 30.0)} select record_id, p, h, h - greatest(lm, rm) as prominence from ta_a",
    "spaced_heart_peaks": f"with {CLEAN}, zu as (select record_id, i, coalesce(x, 0.0) as u from fc),{changes_peaks('zu')},{spaced_peaks('pk', 'sp')} select record_id, p, round(h, 6) as h from sp",
    "tachysystole_per_record": f"with {CLEAN_BOTH},{tachysystole_step(7200, 30.0)} {TACHY}",
    "tachysystole_raw_uc": f"with {CLEAN_RAW_UC},{tachysystole_step(7200, 30.0)} {TACHY}",
    "contraction_count": CONTRACTION_COUNT,
    "sinusoidal_default": f"with {CLEAN},{sinusoidal_step(4800, 20.0)} {SINUS}",
    "sinusoidal_five_minutes": f"with {CLEAN},{sinusoidal_step(1200, 5.0)} {SINUS}",
    "rule_engine": f"with {RULES_RAW},{ALL_FINDINGS} select * replace (round(baseline_confidence, 6) as baseline_confidence) from fx",
    "rule_engine_per_window": PER_WINDOW,
    "window_rules": window_rules(2400, 240, 4800, 20.0),
    "window_rules_with_spectrum": window_rules(1440, 480, 1200, 5.0),
    "prepared_windows": PREPARED,
    "streamed_windows": f"with {CLEAN},{BOUNDS} select b.record_id, b.w, b.start_idx, b.end_idx, count(fc.x) as n_present, round(sum(fc.x), 6) as sum_present from wb b join fc on fc.record_id = b.record_id and fc.i >= b.start_idx and fc.i < b.end_idx group by 1, 2, 3, 4",
    "loose_rule_features": f"with {FINDINGS} select record_id, "
    + RULE_FEATURES.replace("variability_value /", "case when record_id % 5 = 0 or variability_value = 0 then 10.0::double else variability_value end /").format(recurrent="case when early_count > 0 and decel_count / early_count::double > 0.5 then 1.0::double else 0.0::double end")
    + " from fx",
    "rule_feature_columns": f"with {FINDINGS} select record_id, "
    + RULE_FEATURES.format(recurrent="case when early_count > 0 and decel_count / early_count::double > 0.5 then 1.0::double else 0.0::double end")
    + " from fx",
    "feature_tail_per_window": f"with {RULES},{ALL_FINDINGS},{BOUNDS} select b.record_id, b.w, b.start_idx, b.end_idx, cast(length(b.record_id) % 3 as integer) as label, 1035 as width, 1024 as embedding_width, "
    + RULE_FEATURES.format(recurrent="0.0::double").replace(", 6)", ", 4)")
    + " from wb b join fx on fx.record_id = b.record_id",
    "dataset_roundtrip": f"with {SIG},{BOUNDS} select cast(length(record_id) % 3 as integer) as label, count(*) as n_windows, count(*) * 1035 as n_values, max(end_idx) as last_idx from wb group by 1",
    "dataset_audit": f"""with {SIG},{BOUNDS}, lr as (select record_id, length(record_id) % 3 as label, count(*) as c from wb group by 1, 2)
        select count(*) as processed, (select count(distinct event_type) from events) as failed, cast(sum(c) as bigint) as n_windows, cast(coalesce(sum(c) filter (label = 0), 0) as bigint) as label_0,
        cast(coalesce(sum(c) filter (label = 1), 0) as bigint) as label_1, cast(coalesce(sum(c) filter (label = 2), 0) as bigint) as label_2 from lr""",
    "dataset_build": f"""with {CLEAN},{BOUNDS},{STARTS}, lb as (select record_id, length(record_id) % 3 as label, count(*) filter (not high) as c from ps group by 1)
        select count(*) filter (c > 0) as processed, count(*) filter (c = 0) as failed, cast(sum(c) as bigint) as n_windows, cast(coalesce(sum(c) filter (label = 0), 0) as bigint) as label_0,
        cast(coalesce(sum(c) filter (label = 1), 0) as bigint) as label_1, cast(coalesce(sum(c) filter (label = 2), 0) as bigint) as label_2 from lb""",
    "dataset_update": f"""with {SIG},{BOUNDS} select record_id, w, start_idx, end_idx, cast(case when record_id = 'click-0' then 2 else length(record_id) % 3 end as integer) as label,
        (select count(*) from wn) as built_0, cast(0 as bigint) as built_1, cast(1 as bigint) as built_2 from wb""",
    "model_embeddings": f"""select record_id, w, 1024 as width, 0.0::double as low, z_max as high, false as is_mock from ({PREPARED})""",
    "window_quarantine": f"with {CLEAN},{BOUNDS},{STARTS} select record_id, w, start_idx, end_idx, 'ArithmeticError: window starts high' as error from ps where high",
    "feature_name_lookup": """select p_partkey, p_partkey % 1035 as position, case when p_partkey % 1035 < 1024 then printf('moment_emb_%04d', p_partkey % 1035) else
        (['baseline_norm', 'variability_value_norm', 'var_cat_absent', 'var_cat_minimal', 'var_cat_moderate', 'var_cat_marked', 'late_decel_count_norm', 'variable_decel_count_norm',
          'recurrent_decels_flag', 'tachysystole_flag', 'sinusoidal_flag'])[p_partkey % 1035 - 1023] end as name from part""",
    "header_records": f"""with {HEADERS} select record_id, 2 as n_signals, 4.0::double as sampling_rate, n as n_samples, round(n / 4.0::double, 6) as duration_seconds, 0 as fhr_position, 100.0::double as fhr_gain, 'bpm' as fhr_units,
        case when k % 3 = 0 then null else 1 end as uc_position, case when k % 3 = 0 then null else 50.0::double end as uc_gain from hd where not bad_line and not no_fhr""",
    "header_quarantine": f"with {HEADERS} select record_id, case when bad_line then 'unreadable record line' else 'no FHR signal' end as error from hd where bad_line or no_fhr",
    "header_outcomes": f"with {HEADERS} select record_id, ph, case when ph < 7.15 then 2 when ph < 7.20 then 1 else 0 end as label from hd",
    "header_metadata": f"""with {HEADERS} select record_id, 4.0::double as sampling_freq, n as num_samples, 100.0::double as fhr_gain, 0 as fhr_baseline, case when k % 3 > 0 then 50.0::double end as uc_gain,
        case when k % 3 > 0 then 0 end as uc_baseline, 2 as num_signals, round(n / 240.0::double, 6) as duration_min, ph as "pH",
        (c % 130) / 10.0::double as "BDecf", case when k % 11 <> 4 then (k % 90) / 10.0::double end as "pCO2", -((c % 140 + 1) / 10.0::double) as "BE",
        cast(c % 11 as integer) as "Apgar1", cast((c + k) % 11 as integer) as "Apgar5", cast(32 + k % 11 as integer) as gest_weeks, cast(1500 + c % 3000 as double) as weight_g, cast(1 + k % 2 as integer) as sex,
        cast(18 + c % 25 as integer) as maternal_age, case when k % 13 <> 2 then cast(c % 9 as double) end as gravidity, cast(c % 5 as integer) as parity, cast(k % 3 = 0 as integer) as diabetes,
        cast(k % 2 as integer) as hypertension, cast(k % 7 = 0 as integer) as preeclampsia, cast(c % 2 as integer) as meconium, cast(1 + c % 3 as integer) as presentation, cast((k + c) % 2 as integer) as induced,
        cast(30 + c % 400 as integer) as stage1_min, case when k % 5 > 0 then cast(k % 120 as integer) end as stage2_min, cast(1 + (k + 1) % 2 as integer) as delivery_type, cast(12000 + c % 7221 as integer) as pos_stage2
        from hd where not bad_line and not no_fhr""",
    "first_records": "select distinct cast(o_orderkey as varchar) as record_id from orders order by 1 limit 20",
    "decode_signals": f"with {SIG} select record_id, i, round(round(fhr * 100) / 100, 2) as fhr, round(round(uc * 50) / 50, 2) as uc from sig",
    "ingested_samples": f"""with {SIG} select record_id, i, round(round(fhr * 100) / 100, 2) as fhr, round(round(uc * 50) / 50, 2) as uc from sig
        where (cast(split_part(record_id, '-', 2) as int) + length(split_part(record_id, '-', 1))) % 5 = 0""",
    "ingest_quarantine": f"""with {SIG}, k as (select record_id, count(*) as n, (cast(split_part(record_id, '-', 2) as int) + length(split_part(record_id, '-', 1))) % 5 as kind from sig group by 1)
        select record_id, case kind when 1 then 'signal file is short: ' || (4 * n) || ' of ' || (4 * n + 4) || ' bytes' when 2 then 'signal file is missing'
            when 3 then 'signal format is not 16: 212, 16' else 'channels lie in several signal files' end as error from k where kind <> 0""",
    "class_weights": f"with {LABELLED} select label, count(*) as n, round((select count(*) from lb) / ((select count(distinct label) from lb) * count(*))::double, 6) as weight from lb group by 1",
    "weighted_rows": f"""with {LABELLED}, cw as (select label, (select count(*) from lb) / ((select count(distinct label) from lb) * count(*))::double as weight from lb group by 1)
        select record_id, lb.label, round(sum(weight), 6) as weight from lb join cw on cw.label = lb.label group by 1, 2""",
    "confusion_matrix": f"with {LABELLED} select label, count(*) filter (prediction = 0) as predicted_0, count(*) filter (prediction = 1) as predicted_1, count(*) filter (prediction = 2) as predicted_2 from lb group by 1",
    "classification_report": f"with {LABELLED},{cells_report('lb')} {REPORT_TAIL}",
    "macro_f1": f"with {LABELLED},{cells_report('lb')} select round(avg(f1), 6) as macro_f1 from pm",
    "label_quality_report": f"with lq as (select quality as label, toxic as prediction from labels where quality is not null and toxic is not null),{cells_report('lq')} {REPORT_TAIL}",
    "cv_summary": f"""with {LABELLED}, sc as (select record_id, avg(case when label = prediction then 1.0::double else 0.0::double end) as s from lb group by 1)
        select round(avg(s), 6) as mean_score, round(stddev_pop(s), 6) as std_score, round(max(s), 6) as best_score from sc""",
    "majority_vote": """with vt as (select l_suppkey as record_id, cast(l_partkey % 3 as integer) as p, count(*) as c, min(l_orderkey * 10 + l_linenumber) as f from lineitem group by 1, 2)
        select record_id, p as ml_prediction from (select *, row_number() over (partition by record_id order by c desc, f) as rk from vt) where rk = 1""",
    "mean_confidence": """select l_suppkey as record_id, round(avg(greatest(l_quantity, l_discount * 100, l_tax * 100 + 1) / (l_quantity + l_discount * 100 + (l_tax * 100 + 1))), 6) as confidence from lineitem group by 1""",
    "stratified_folds": """select o_orderkey, o_orderstatus as label, cast((row_number() over (partition by o_orderstatus order by md5(cast(o_orderkey as varchar) || ':42')) - 1) % 5 as integer) as fold from orders""",
    "grouped_folds": f"with {LABELLED} select l.record_id, g.fold, count(*) as n from lb l join (select record_id, cast((row_number() over (order by md5(record_id || ':42')) - 1) % 3 as integer) as fold from (select distinct record_id from lb)) g using (record_id) group by 1, 2",
    "contiguous_labels": """with cl as (select vec_id, label % 4 * 10 + 5 as l from embeddings)
        select vec_id, l as old_label, cast(dense_rank() over (order by l) - 1 as integer) as new_label from cl""",
    "category_lookup": "select o_orderkey, "
    + sql_list({0: "Normal (Category 1)", 1: "Intermediate (Category 2)", 2: "Pathological (Category 3)"}, "o_orderkey % 5", "'Unknown'")
    + " as name, " + sql_list({1: "green", 2: "orange", 3: "red"}, "o_orderkey % 5", "'gray'")
    + " as color, " + sql_list({1: "🟢", 2: "🟠", 3: "🔴"}, "o_orderkey % 5", "'⚪'")
    + " as emoji, " + sql_list({1: "#28a745", 2: "#fd7e14", 3: "#dc3545"}, "o_orderkey % 5", "null") + " as hex from orders",
    "rule_only_class": f"with {FINDINGS} select record_id, {RULE_CLASS} as rule_class from fx",
    "safety_override": f"""with {FINDINGS},{OVERRIDE} select record_id, should_override, final_category,
        case rule when 1 then 'SINUSOIDAL_PATTERN' when 2 then 'ABSENT_VARIABILITY_WITH_DECELS' when 3 then 'ABSENT_VARIABILITY_SAFETY_FLOOR' else 'NONE' end as reason,
        case rule when 1 then 'Sinusoidal pattern detected. This is a critical finding indicating potential severe fetal anemia or compromise. Classification forced to Category 3 (Pathological) regardless of ML prediction.'
            when 2 then 'Absent FHR variability with ' || found || '. This combination is highly predictive of fetal acidemia. Classification forced to Category 3 (Pathological) regardless of ML prediction.'
            when 3 then 'Safety floor activated: ML predicted Normal (Category 1) but FHR variability is Absent. Absent variability requires closer monitoring. Classification upgraded to Category 2 (Intermediate).'
            else 'No medical override triggered. Using ML prediction: Category ' || cast(ml_prediction + 1 as varchar) || '.' end as override_explanation,
        """ + sql_list({0: "Normal (Category 1)", 1: "Intermediate (Category 2)", 2: "Pathological (Category 3)"}, "final_category", "'Unknown'") + " as category_name from dc",
    "explained_alerts": f"with {FINDINGS},{OVERRIDE},{ALERT} select * from alert",
    "findings_summary": f"""with {FINDINGS} select record_id, case when baseline between 110 and 160 then 'green' else 'red' end as baseline_color,
        case when variability_category = 'Moderate' then 'green' when variability_category in ('Minimal', 'Marked') then 'orange' else 'red' end as variability_color,
        case when late_count > 0 then 'red' else 'green' end as late_color, case when variable_count > 0 then 'orange' else 'green' end as variable_color, case when tachysystole then 'red' else 'green' end as tachysystole_color,
        printf('%.0f bpm', baseline) as baseline_text, printf('%.1f bpm', variability_value) as variability_text, cast(late_count as varchar) as late_text, cast(variable_count as varchar) as variable_text,
        case when tachysystole then 'כן' else 'לא' end as tachysystole_text from fx""",
    "deceleration_overlay": f"""with {CLEAN_BOTH},{BASELINE},{DECELS}, ol as (select *, row_number() over (partition by record_id order by start_idx) <= 5 as shown from decels)
        select record_id, start_idx, round(start_idx / 240.0::double, 6) as start_minute, round(end_idx / 240.0::double, 6) as end_minute,
        case decel_type when 'Late' then 'rgba(255, 0, 0, 0.3)' when 'Variable' then 'rgba(255, 165, 0, 0.3)' when 'Prolonged' then 'rgba(128, 0, 128, 0.3)' else 'rgba(100, 100, 100, 0.2)' end as fill_color,
        case when not shown then null when decel_type = 'Late' then 'האטה מאוחרת' when decel_type = 'Variable' then 'האטה משתנה' when decel_type = 'Prolonged' then 'האטה ממושכת' else 'האטה' end as label,
        case when shown then round((start_idx / 240.0::double + end_idx / 240.0::double) / 2, 6) end as label_minute, case when shown then nadir_value end as label_bpm from ol""",
    "score_records": f"with {RULES},{ALL_FINDINGS.replace('fx as', 'fy as')}, fx as (select *, {RULE_CLASS} as ml_prediction, 0.7::double as confidence from fy),{OVERRIDE},{ALERT} select * from alert",
    "score_with_votes": f"with {RULES},{ALL_FINDINGS.replace('fx as', 'fy as')}, fx as (select *, cast(length(record_id) % 3 as integer) as ml_prediction, 0.5::double as confidence from fy),{OVERRIDE},{ALERT} select * from alert",
    "trained_predictions": f"with {LABELLED} select record_id, w, label, true as known_class, true as shares, 1.0::double as total from lb",
    "saved_model_predictions": f"with {LABELLED} select record_id, w, true as same, true as same_params from lb",
    "classifier_votes": f"with {LABELLED} select distinct record_id, true as is_majority, true as is_share from lb",
    "one_round_boosting": """with li as (select case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as y, cast(round(l_linenumber) as integer) as line,
            cast(round(l_discount * 100) as integer) as discount, cast(round(l_tax * 100) as integer) as tax from lineitem),
        cw as (select y, (select count(*) from li) / (count(distinct y) over () * c::double) as w from (select y, count(*) as c from li group by 1)),
        ft as (select li.*, cw.w from li join cw using (y)),
        lv as (select k, j, v, sum(w * (1.0::double / 3 - case when y = k then 1 else 0 end)) as g, sum(w * 4.0::double / 9) as h
            from (select y, w, unnest([0, 1, 2]) as j, unnest([line, discount, tax]) as v from ft) cross join (select unnest([0, 1, 2]) as k) group by 1, 2, 3),
        cu as (select k, j, v, sum(g) over a as gl, sum(h) over a as hl, sum(g) over b as ga, sum(h) over b as ha from lv
            window a as (partition by k, j order by v), b as (partition by k, j)),
        gn as (select *, 0.5 * (gl ** 2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga ** 2 / (ha + 1)) as gain from cu where hl >= 1 and ha - hl >= 1),
        tr as (select k, arg_max(struct_pack(j, v, gl, hl, ga, ha), gain) as s from gn group by 1),
        mg as (select l.line, l.discount, l.tax, l.n, tr.k, case when [l.line, l.discount, l.tax][s.j + 1] <= s.v then -0.5 * s.gl / (s.hl + 1) else -0.5 * (s.ga - s.gl) / (s.ha - s.hl + 1) end as m
            from (select line, discount, tax, count(*) as n from li group by 1, 2, 3) l cross join tr)
        select line, discount, tax, n, round(exp(max(m) filter (k = 0)) / sum(exp(m)), 6) as p0, round(exp(max(m) filter (k = 1)) / sum(exp(m)), 6) as p1, round(exp(max(m) filter (k = 2)) / sum(exp(m)), 6) as p2
        from mg group by 1, 2, 3, 4""",
    "cross_validated_training": "select 5 as n_folds, true as mean_inside, true as best_is_share",
    "feature_importances": "select cast(unnest(range((select max(len(embedding)) from embeddings))) as integer) as position, true as is_share, 1.0::double as total",
    "train_job": "select count(*) as n_samples, true as scores_are_shares, count(*) as n_predicted from embeddings",
    "window_embeddings": f"with {SIG},{BOUNDS} select record_id, w, start_sec, end_sec, 1024 as width, 1.0::double as norm from wb",
    "feature_rows": f"with {SIG},{BOUNDS} select record_id, w, start_idx, end_idx, cast(length(record_id) % 3 as integer) as label, 1035 as width, true as finite from wb",
    "record_detail": f"with {RULES},{ALL_FINDINGS} select record_id, printf('%.0f bpm', baseline) as baseline, printf('%.1f bpm', variability_value) as variability, upper(variability_category) as variability_category, late_count, variable_count, decel_count from fx",
    "unprocessed_records": "select p_partkey as record_id from part where not exists (select 1 from lineitem where l_suppkey = p_partkey)",
}


def exact_rounding(statement: str) -> str:
    """Round the binary value: printf writes it out exactly, while round_even works on its decimal text."""
    while (at := statement.find("round_even(")) >= 0:
        depth, k, comma = 0, at + len("round_even"), -1
        while True:
            c = statement[k]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = k
            if depth == 0:
                break
            k += 1
        inner, digits = statement[at + len("round_even(") : comma], int(statement[comma + 1 : k])
        statement = f"{statement[:at]}(cast(printf('%.{digits}f', cast({inner} as double)) as double) + 0.0){statement[k + 1:]}"
    return statement


STATEMENTS = {name: exact_rounding(statement) for name, statement in STATEMENTS.items()}
