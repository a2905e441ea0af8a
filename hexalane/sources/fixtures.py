"""Race tables derived from the star-schema test tables by integer arithmetic.

The same SQL text runs on Spark (over DataFrames) and on the oracle engine, so
both sides of a comparison see equal rows.  Every derived table is a narrow
projection of ``orders`` or ``events``; nothing is cached or collected.
"""

from pyspark.sql import DataFrame, SparkSession

from ..functions.patterns import PATTERNS, combos
from ..operators.spread import tasks

FIXTURES = """
h as (select o_orderkey k, o_custkey c, cast(o_orderdate as date) race_date, o_orderdate ots, o_totalprice p,
  (o_orderkey*7919 + o_custkey*104729) % 1000 q, (o_orderkey*31 + o_custkey*17) % 5 h2, (o_orderkey*13 + o_custkey*7) % 4 h3,
  lpad(cast(1 + o_custkey % 24 as string), 2, '0') venue_code, 1 + o_orderkey % 12 race_number from {orders}),
places as (select *, case when q < 550 then 1 else 2 + q % 5 end r1 from h),
places2 as (select *, 1 + h2 + case when 1 + h2 >= r1 then 1 else 0 end r2 from places),
places3 as (select *, 1 + h3 + case when 1 + h3 >= least(r1, r2) then 1 else 0 end c1 from places2),
race_result as (select k race_id, race_date, venue_code, race_number, r1 result_1, r2 result_2,
  c1 + case when c1 >= greatest(r1, r2) then 1 else 0 end result_3,
  concat(cast(r1 as string), '-', cast(r2 as string), '-', cast(c1 + case when c1 >= greatest(r1, r2) then 1 else 0 end as string)) trifecta,
  cast(floor(p/100)*10 as bigint) payout_trifecta, cast(4000 + (c + 37) % 500 as string) boat1_registration_number,
  case when k % 11 = 0 then null else concat('racer ', cast((c + 37) % 500 as string)) end boat1_racer_name,
  case (c + 1) % 4 when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end boat1_grade_class,
  cast(10 + (k*7 + 3) % 16 as double)/100 boat1_avg_st, 10 + (k*7 + 3) % 16 st_hundredths, k % 3 boat1_f_count,
  case k % 4 when 0 then '晴' when 1 then '曇' when 2 then '雨' else null end weather, cast(k % 9 as double) wind_speed from places3),
race as (select k race_id, race_date, venue_code, race_number, ots deadline,
  case k % 5 when 0 then 'SG' when 1 then 'G1' when 2 then 'G3' else 'GENERAL' end grade,
  concat(venue_code, '_', substr(cast(race_date as string), 1, 7)) series_key, 1 + k % 6 series_day,
  case when k % 10 = 0 then null else concat('race ', cast(k % 12 as string)) end race_name,
  case k % 4 when 0 then '晴' when 1 then '曇' when 2 then '雨' else null end weather, case when k % 7 = 0 then null else cast(k % 9 as double) end wind_speed,
  case when k % 3 = 0 then 'scheduled' else 'finished' end status, case when k % 13 = 0 then null when k % 17 = 0 then 'sample' else 'official' end data_source,
  (k % 5 <> 0) exhibition_ready from h),
race_entry as (select k race_id, race_date, venue_code, race_number, b.boat_number, cast(4000 + (c + b.boat_number*37) % 500 as string) registration_number,
  case (c + b.boat_number) % 4 when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end grade_class,
  cast(300 + (k*17 + b.boat_number*101) % 500 as double)/100 national_win_rate, cast(150 + (k*19 + b.boat_number*41) % 450 as double)/10 national_2rate,
  case when (k + b.boat_number) % 10 = 0 then null else cast(250 + (k*23 + b.boat_number*43) % 500 as double)/10 end national_3rate,
  case when (k + b.boat_number) % 7 = 0 then null else cast(300 + (k*29 + b.boat_number*59) % 500 as double)/100 end local_win_rate,
  cast(150 + (k*31 + b.boat_number*61) % 450 as double)/10 local_2rate, cast(250 + (k*37 + b.boat_number*67) % 500 as double)/10 local_3rate,
  case when k % 4 = 0 then null else cast(300 + (k*41 + b.boat_number*71) % 500 as double)/10 end c1_win_rate,
  cast(150 + (k*11 + b.boat_number*29) % 400 as double)/10 motor_2rate, cast(250 + (k*43 + b.boat_number*73) % 400 as double)/10 motor_3rate,
  cast(150 + (k*47 + b.boat_number*79) % 400 as double)/10 boat_2rate, cast(250 + (k*53 + b.boat_number*83) % 400 as double)/10 boat_3rate,
  cast(10 + (k*7 + b.boat_number*3) % 16 as double)/100 avg_st, case when (k + b.boat_number) % 13 = 0 then 1 else 0 end f_count,
  cast(660 + (k*3 + b.boat_number*7) % 40 as double)/100 exhibition_time, cast(5 + (k*5 + b.boat_number*11) % 25 as double)/100 exhibition_st,
  case when (k + b.boat_number) % 23 = 0 then 2 else b.boat_number end entry_course, (k + b.boat_number) % 31 = 0 is_scratched,
  1 + (k + b.boat_number*5) % 6 finish_order, case when (k + b.boat_number) % 29 = 0 then 'F' when (k + b.boat_number) % 37 = 0 then 'L' else concat('0.', cast(10 + (k*7 + b.boat_number*3) % 16 as string)) end start_timing,
  case when (k + b.boat_number) % 3 = 0 then null else cast(500 + (k*13 + b.boat_number*31) % 450 as double)/10 end c1_2rate,
  case when (k + b.boat_number) % 4 = 0 then null else cast((k*3 + b.boat_number*11) % 500 as double)/10 end term_course_first, case when (k + b.boat_number) % 5 = 0 then null else cast((k*5 + b.boat_number*13) % 400 as double)/10 end term_first,
  case when (k + b.boat_number) % 4 = 1 then null else cast((k*7 + b.boat_number*17) % 300 as double)/10 end term_course_second, cast((k*9 + b.boat_number*19) % 280 as double)/10 term_second,
  case when (k + b.boat_number) % 4 = 2 then null else cast((k*11 + b.boat_number*23) % 300 as double)/10 end term_course_third, cast((k*15 + b.boat_number*29) % 280 as double)/10 term_third,
  case when (k + b.boat_number) % 3 = 1 then null else cast(100 + (k*17 + b.boat_number*31) % 550 as double)/10 end term_course_top2, case when (k + b.boat_number) % 8 = 0 then null else cast(100 + (k*19 + b.boat_number*37) % 520 as double)/10 end term_top2,
  case when (k + b.boat_number) % 3 = 2 then null else cast(200 + (k*21 + b.boat_number*41) % 600 as double)/10 end term_course_top3, case when (k + b.boat_number) % 9 = 0 then null else cast(200 + (k*23 + b.boat_number*43) % 580 as double)/10 end term_top3,
  case when (k + b.boat_number) % 6 = 0 then null else cast(300 + (k*25 + b.boat_number*47) % 350 as double)/10 end term_ability, case when (k + b.boat_number) % 7 = 1 then null else cast(10 + (k*27 + b.boat_number*53) % 14 as double)/100 end term_st,
  case when (k + b.boat_number) % 5 = 1 then null else cast(300 + (k*29 + b.boat_number*59) % 500 as double)/100 end term_win, cast((k*31 + b.boat_number*61) % 120 - 60 as double)/10 term_ability_trend, cast((k*33 + b.boat_number*67) % 200 - 100 as double)/100 term_win_trend,
  cast((k + b.boat_number*5) % 3 as double)/2 term_f, cast((k + b.boat_number*7) % 4 as double)/2 term_l, cast((k*35 + b.boat_number*71) % 100 as double)/10 term_championship_entry, cast((k*37 + b.boat_number*73) % 40 as double)/10 term_championship_win,
  case when (k + b.boat_number) % 10 = 3 then null else (k + b.boat_number*3) % 6 end series_runs, cast((k*39 + b.boat_number*79) % 1000 as double)/10 series_score, case when (k + b.boat_number) % 11 = 0 then null else cast((k*41 + b.boat_number*83) % 1000 as double)/10 end series_pressure,
  cast(10 + (k*43 + b.boat_number*89) % 50 as double)/10 series_avg_lane, (k + b.boat_number) % 4 series_inner_lanes, (k + b.boat_number) % 14 = 0 series_exclusion,
  case when (k + b.boat_number) % 4 = 0 then cast(race_date - interval '2' day as date) else cast(race_date - interval '1' day as date) end series_as_of,
  case when (k*3 + b.boat_number) % 17 = 0 then null else cast(660 + (k*3 + b.boat_number*7) % 40 as double)/100 end warmup_time, case when (k*5 + b.boat_number) % 19 = 0 then null else cast(2 + (k*5 + b.boat_number*11) % 25 as double)/100 end warmup_st,
  (k + b.boat_number) % 16 = 0 warmup_false_start, case when (k + b.boat_number) % 4 <> 0 then 0 else 1 + (k + b.boat_number) % 6 end warmup_rank
  from h cross join (values (1), (2), (3), (4), (5), (6)) b(boat_number)),
race_head as (select k race_id, race_date, venue_code, race_number, case k % 12 when 0 then '準優勝戦' when 1 then '優勝戦' when 2 then '特選' when 3 then '選抜戦' when 4 then '一般戦' when 5 then null else '予選' end race_name,
  case k % 9 when 0 then 'SEMIFINAL' when 1 then 'FINAL' when 2 then null else 'OTHER' end race_phase, 1 + (k % 35) % 6 series_day, case k % 5 when 0 then 'SG' when 1 then 'G1' when 2 then 'G3' else 'GENERAL' end grade, (k*3) % 7 <> 0 exhibition_ready, k % 20 = 0 has_scratch,
  case k % 4 when 0 then '晴' when 1 then '曇' when 2 then '雨' else null end weather, case when k % 7 = 0 then null else cast(k % 9 as double) end wind_speed from h),
file_fields as (select k, 1 + k % 6 boat, cast(4000 + c % 500 as string) reg, 20 + k % 40 age, 45 + k % 20 weight, case k % 4 when 0 then 'A1' when 1 then 'A2' when 2 then 'B1' else 'B2' end grade, 300 + (k*17) % 500 nat, 1000 + (k*19) % 4000 n2, 300 + (k*29) % 500 loc, 1000 + (k*31) % 4000 l2,
  10 + (k*7) % 170 motor, 1000 + (k*37) % 4000 m2, 10 + (k*11) % 170 bno, 1000 + (k*41) % 4000 b2, k % 13 = 0 short from h),
file_stats as (select *, concat(@nat, ' ', @n2, ' ', @loc, case when short then '' else concat(' ', @l2, case when motor >= 100 then '' else ' ' end, cast(motor as string), ' ', @m2, case when bno >= 100 then '' else ' ' end, cast(bno as string), ' ', @b2, ' ', case k % 4 when 0 then '123 5' when 1 then '7' when 2 then 'F12' else '1 2 3 11' end) end) stats_line from file_fields),
file_lines as (select *, case when k % 10 = 0 then '-----' else concat(cast(boat as string), ' ', reg, '山田　太郎', cast(age as string), '福岡', cast(weight as string), grade, ' ', stats_line) end program_line,
  case when k % 10 = 0 then '  a line of another kind, long enough to be looked at by its places' else concat('  ', case when k % 7 < 4 then lpad(cast(1 + k % 6 as string), 2, '0') when k % 7 = 4 then 'S1' when k % 7 = 5 then 'F ' else 'K0' end, '  ', cast(boat as string), ' ', reg, ' ', '山田　太郎　　　', ' ', case when k % 9 = 0 then ' -' else lpad(cast(motor % 100 as string), 2, ' ') end, '   ', lpad(cast(bno % 100 as string), 2, ' '), ' ', '6.', cast(60 + k % 40 as string), ' ', '   ', cast(boat as string), '    ', '0.12', '     ', case when k % 5 = 0 then '転覆　　　　' when k % 5 = 1 then '落水　　　　' else '1.49.8' end) end result_line,
  case when k % 6 = 0 then '払戻金' else concat('   ', cast(1 + k % 12 as string), 'R       ', case k % 2 when 0 then '予　選' else '一般戦' end, '        H1800m  ', case k % 3 when 0 then '晴' else '雨' end, '  風  南西   ', cast(k % 9 as string), 'm  波   ', cast(k % 11 as string), 'cm') end header_line,
  case k % 7 when 0 then concat(' 単勝     4     ', cast(100 + k % 900 as string)) when 1 then concat('複勝     1   ', cast(100 + k % 900 as string), case when k % 14 = 1 then '  2   110' else '' end) when 2 then concat('2連単   4-1   ', cast(100 + k % 900 as string), '  人気     ', cast(1 + k % 20 as string)) when 3 then concat('3連複   1-2-3   ', cast(100 + k % 900 as string), '  人気     ', cast(1 + k % 20 as string))
    when 4 then concat('拡連複   1-4   ', cast(100 + k % 900 as string), '  人気     ', cast(1 + k % 20 as string)) when 5 then concat('         4-5   ', cast(100 + k % 900 as string), '  人気     ', cast(1 + k % 20 as string)) else '2連複      特払い   70' end payout_line,
  concat(reg, repeat('n', 16), repeat('k', 15), 'FKOK', 'B1', 'H', '850101', '1', lpad(cast(age as string), 2, '0'), '170', '52', 'A ', lpad(cast(nat as string), 4, '0'), lpad(cast(n2 % 1000 as string), 4, '0'), case when k % 8 = 0 then ' - ' else lpad(cast(k % 200 as string), 3, '0') end, '012', cast(100 + k % 100 as string), '03', '01', lpad(cast(10 + k % 16 as string), 3, '0'),
    repeat(' ', 78), 'A2', 'B1', 'B1', '0500', lpad(cast(m2 as string), 4, '0'), '2020', '1', '20191101', '20200430', '088', lpad(cast(k % 50 as string), 3, '0'), repeat('0', 31), repeat('0', 34), '000000', lpad(cast(k % 7 as string), 3, '0'), repeat('0', 25), repeat('0', 102), repeat(' ', 14)) term_line from file_stats),
day_venue as (select *, substr(cast(race_date as string), 3, 2) yy, substr(cast(race_date as string), 6, 2) mm, substr(cast(race_date as string), 9, 2) dd, (cast(venue_code as int) + cast(substr(cast(race_date as string), 9, 2) as int)) % 9 m9,
  case when (cast(venue_code as int) * cast(substr(cast(race_date as string), 9, 2) as int)) % 31 = 0 then '25' else venue_code end code from (select distinct race_date, venue_code from h)),
day_section as (select *, case m9 when 0 then null when 1 then '2026-01-01' else cast(race_date as string) end shown, concat(yy, mm, dd, '.TXT') file_name from day_venue),
day_race as (select s.*, h.k, h.c, h.race_number, k % 17 = 0 odd_head, case when k % 19 = 0 then 5 else 6 end boats, case when m9 = 0 then concat(code, '_', lpad(cast(h.race_number as string), 2, '0')) else concat(shown, '_', code, '_', lpad(cast(h.race_number as string), 2, '0')) end race_key
  from h join day_section s on s.race_date = h.race_date and s.venue_code = h.venue_code),
day_boat as (select r.*, b.n boat, cast(4000 + (c + b.n * 37) % 500 as string) reg, 20 + (k + b.n) % 40 age, 45 + (k + b.n) % 20 weight from day_race r cross join (values (1), (2), (3), (4), (5), (6)) b(n) where b.n <= r.boats),
b_text as (select distinct file_name, '' v, 0 part, 0 rn, 0 k, 0 seq, 'STARTB' text from day_section
  union all select file_name, venue_code, 1, 0, 0, x.i, case x.i when 0 then concat(code, 'BBGN') when 1 then '  シリーズ　' when 2 then concat('   第　', cast(1 + m9 as string), '日        ', case when m9 = 0 then '' when m9 = 1 then '２０２６年　１月　１日' else concat(substr(cast(race_date as string), 1, 4), '年　', cast(cast(mm as int) as string), '月', cast(cast(dd as int) as string), '日') end) else '' end
    from day_section cross join (values (0), (1), (2), (3)) x(i)
  union all select file_name, venue_code, 2, race_number, k, 0, concat('　', cast(race_number as string), 'Ｒ  予　選    Ｈ１８００ｍ  ', case when odd_head then '' else concat('電話投票締切予定1', cast(k % 10 as string), ':', lpad(cast(k % 60 as string), 2, '0')) end) from day_race
  union all select file_name, venue_code, 2, race_number, k, boat, concat(cast(boat as string), ' ', reg, '山田　太郎', cast(age as string), '福岡', cast(weight as string), case k % 2 when 0 then 'A1' else 'B2' end, ' 5.40 34.13 5.33 38.10 24 57.14158 42.86 56           5') from day_boat
  union all select file_name, venue_code, 3, 0, 0, 0, concat(code, 'BEND') from day_section),
b_lines as (select concat('B', file_name) file, cast(row_number() over (partition by file_name order by v, part, rn, k, seq) as int) line, text from b_text),
k_text as (select distinct file_name, '' v, 0 part, 0 rn, 0 k, 0 seq, 'STARTK' text from day_section
  union all select file_name, venue_code, 1, 0, 0, x.i, case x.i when 0 then concat(code, 'KBGN') when 1 then concat('　第 ', cast(1 + m9 as string), '日     ', case when m9 = 0 then '' when m9 = 1 then '2026/ 1/ 1' else concat(substr(cast(race_date as string), 1, 4), '/', lpad(cast(cast(mm as int) as string), 2, ' '), '/', lpad(cast(cast(dd as int) as string), 2, ' ')) end) when 2 then '   [払戻金] 1R  2026/ 5/ 5' else '' end
    from day_section cross join (values (0), (1), (2), (3)) x(i)
  union all select file_name, venue_code, 2, race_number, k, x.i, case x.i when 0 then concat('   ', cast(race_number as string), 'R       予　選      H1800m  ', case when odd_head then '晴' else concat('晴  風  南西  ', cast(k % 9 as string), 'm  波   ', cast(k % 11 as string), 'cm') end) when 1 then '  着 艇 登番 選　手　名　　ﾓｰﾀｰ ﾎﾞｰﾄ 展示 進入 ｽﾀｰﾄﾀｲﾐﾝｸﾞ ﾚｰｽﾀｲﾑ 逃げ' when 2 then '------' when 10 then '' when 11 then concat('     単勝     1          ', cast(100 + k % 900 as string)) when 12 then concat('     拡連複   1-4        ', cast(200 + k % 900 as string), '  人気     1') when 13 then concat('              4-5        ', cast(300 + k % 900 as string), '  人気     7') when 16 then case when k % 23 = 0 then ' noted' else '' end else '' end
    from day_race cross join (values (0), (1), (2), (10), (11), (12), (13), (14), (15), (16)) x(i) where k % 29 <> 0 or x.i in (0, 1, 2)
  union all select file_name, venue_code, 2, race_number, k, 3 + boat, concat('  ', lpad(cast(case when k % 31 = 0 and boat = 2 then 1 + k % 6 else 1 + (k + boat - 1) % 6 end as string), 2, '0'), '  ', cast(boat as string), ' ', reg, ' 山田　太郎　　　 ', lpad(cast(age as string), 2, ' '), '   ', lpad(cast(weight as string), 2, ' '), ' 6.7', cast(boat as string), '    ', cast(boat as string), '    0.12     1.49.8') from day_boat where k % 29 <> 0
  union all select file_name, venue_code, 3, 0, 0, 0, concat(code, 'KEND') from day_section),
k_lines as (select concat('K', file_name) file, cast(row_number() over (partition by file_name order by v, part, rn, k, seq) as int) line, text from k_text),
odds_final as (select k race_id, x.combo, case when (k + x.i) % 23 = 0 then null when (k + x.i) % 29 = 0 then 0.0e0 else cast(60 + (k*31 + x.i*17) % 900 as double)/10 end odds from h cross join (values @combos) x(i, combo)),
uichi_analysis as (select k race_id, race_date, venue_code, race_number, case when (k + v.n) % 3 = 0 then 'pre' else 'final' end stage, v.n dup_no,
  case (k*7 + v.n) % 4 when 0 then 'BUY' when 1 then 'WATCH' when 2 then 'SKIP' else 'PENDING' end judgment,
  case when k % 19 = 0 then null else cast(80 + (k*37 + v.n*11) % 160 as double) end expected_value, ots captured_at,
  case k % 5 when 0 then 'S' when 1 then 'A' when 2 then 'B' else 'C' end pre_grade, (k*3 + v.n) % 101 boat1_trust_score, (k + v.n) % 2 = 0 exhibition_ready,
  case (k + v.n*3) % 5 when 0 then 'PASS' when 1 then 'CAUTION' when 2 then 'FAIL' when 3 then 'MISSING' else 'PRE' end exhibition_gate_status,
  case when (k + v.n) % 6 = 0 then null else cast(660 + k % 40 as double)/100 end exhibition_time
  from h cross join (values (0), (1)) v(n)),
odds_snapshot as (select 1 + event_id % 500 race_id, event_id tick_id, ts captured_at, x.combo, cast(8 + (event_id*31 + x.i*17) % 500 as double)/10 odds
  from {events} cross join (values (0, '1-2-5'), (1, '1-2-6'), (2, '1-3-5'), (3, '1-3-6'), (4, '1-4-5'), (5, '1-4-6')) x(i, combo)),
alert as (select k race_id, race_date, venue_code, race_number, v.n dup_no, case when k % 7 = 0 then 'filtered_out' when k % 2 = 0 then 'active' else 'resolved' end status,
  case (k*5 + v.n) % 4 when 0 then 'BUY' when 1 then 'WATCH' when 2 then null else 'PENDING' end final_judgment,
  case k % 5 when 0 then 'S' when 1 then 'A' when 2 then 'B' else null end pre_grade, case when k % 3 = 0 then null else cast(k % 40 as double)/100 end pre_appearance_rate,
  cast(k % 60 as double) final_expected_value from h cross join (values (0), (1)) v(n) where k % 4 <> 3),
player_structure as (select k race_id, (k*41) % 101 main_score, (k*59) % 101 ura_score from h),
racer as (select distinct c % 500 r from h),
racer_term as (select cast(4000 + r as string) registration_number, t.n term_no, concat('T', cast(t.n as string)) term_code, 20 + (r*7 + t.n*13) % 80 race_count,
  (r*3 + t.n) % 20 first_place_count, (r*5 + t.n) % 18 second_place_count, cast(300 + (r*11 + t.n*17) % 500 as double)/100 win_rate,
  case when (r + t.n) % 9 = 0 then null else cast(30 + (r*13 + t.n*19) % 50 as double) end ability_index, cast(10 + (r*7 + t.n*3) % 16 as double)/100 average_start_timing
  from racer cross join (values (1), (2), (3), (4), (5), (6), (7)) t(n) where (r + t.n) % 5 <> 0),
series_point as (select k point_id, concat(venue_code, '_', substr(cast(race_date as string), 1, 7)) series_key, venue_code, race_date as_of_date,
  cast(4000 + (c + 37) % 500 as string) registration_number, 1 + k % 40 rank_no, cast(k % 1000 as double)/10 series_score, k % 6 races_run from h),
learning_sample as (select r.race_id, r.race_date, r.venue_code, r.race_number, r.trifecta, r.result_1, r.result_2, r.result_3,
  case r.race_id % 3 when 0 then 'MAIN' when 1 then 'URA' else null end program_hypothesis, case r.race_id % 4 when 0 then 'VALID' when 1 then 'PLAYER_BREAK' when 2 then 'NEUTRAL' else null end program_scenario_status,
  case r.race_id % 5 when 0 then 'MAIN' when 1 then 'URA' when 2 then 'NEW_MAIN' when 3 then 'NEW_URA' else 'NEUTRAL' end recommended_pattern,
  (r.race_id*7) % 101 program_intent_confidence, (r.race_id*11) % 101 racer_escape_execution, case when r.race_id % 8 = 0 then null else (r.race_id*13) % 101 end direction_confidence,
  case r.race_id % 3 when 0 then 'QUALIFYING' when 1 then 'FINAL' else null end logic_mode, 1 + r.race_id % 6 series_day,
  case r.race_id % 4 when 0 then 'BUY' when 1 then 'WATCH' when 2 then 'SKIP' else 'PENDING' end final_judgment from race_result r),
official_old as (select k, concat(cast(race_date as string), '_', venue_code, '_', lpad(cast(race_number as string), 2, '0'), '_', cast(k as string)) entry_key, venue_code, race_number,
  cast(4000 + (c + 37) % 500 as string) registration_number, case when k % 5 = 0 then null else k % 50 end motor_number, case when k % 3 = 0 then 'CONFIRMED' else 'PROVISIONAL' end record_status
  from h where k % 97 <> 0),
official_new as (select k, concat(cast(race_date as string), '_', venue_code, '_', lpad(cast(race_number as string), 2, '0'), '_', cast(k as string)) entry_key, venue_code, race_number,
  case when k % 83 = 0 then '9999' else cast(4000 + (c + 37) % 500 as string) end registration_number, case when k % 6 = 0 then null else k % 50 end motor_number, 'PROVISIONAL' record_status
  from h where k % 89 <> 1)
""".replace("@combos", ", ".join(f"({i}, '{c}')" for i, c in enumerate(c for p in PATTERNS for c in combos(p))))
for _n in ("nat", "n2", "loc", "l2", "m2", "b2"):  # hundredths as text with two decimals
    FIXTURES = FIXTURES.replace(f"@{_n},", f"concat(cast(cast(floor({_n} / 100) as bigint) as string), '.', lpad(cast({_n} % 100 as string), 2, '0')),")


#: Rows of a task from which tables are derived; a race becomes up to 120 odds or 280 fields.
ROWS = 50_000
#: The test tables that others are derived from, and their keys.
KEYS = {"orders": "o_orderkey", "events": "event_id"}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    tables = {t: _spread(spark.read.parquet(f"{sf_dir}/{t}.parquet"), key) for t, key in KEYS.items()}
    return spark.sql(f"with {FIXTURES} select * from {name}", **tables)


def tasks_for(spark: SparkSession, sf_dir: str, table: str, rows: int) -> int:
    """Tasks for tables that derive ``rows`` rows from each row of a test table."""
    return tasks(spark, rows * spark.read.parquet(f"{sf_dir}/{table}.parquet").count())


def _spread(table: DataFrame, key: str | None = None) -> DataFrame:
    """A table of fewer partitions than there are cores, or of more than ``ROWS`` rows in each, is dealt out, by its key if one is given: what is derived from a row costs more than its move.

    So a task's rows, and with them its memory and time, stay the same as the table grows; and all
    that is derived from a row and keyed by it (the boats of a race) is in one task already, and
    neither aggregated nor joined by way of another shuffle of rows many times as wide.
    """
    cores, own = table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions()
    wanted = max(cores, -(-table.count() // ROWS))
    return table.repartition(wanted, *([key] if key else [])) if own < wanted else table


def oracle(body: str) -> str:
    """SQL for the oracle engine over the derived tables; ``body`` starts with further named queries or with ``select``."""
    head = "with " + FIXTURES.replace("{orders}", "orders").replace("{events}", "events")
    return f"{head} {body}" if body.lstrip().lower().startswith("select") else f"{head}, {body}"
