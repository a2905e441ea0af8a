"""Parsers of official files and feeds: lines are made from known fields, and the SQL states the fields."""

from pyspark.sql import functions as F

from ..functions import official as of
from ..functions import pages, text
from ..sources import official_files as of_files
from ..sources.fixtures import fixture
from .registry import query


def _lines(spark, d, name="file_lines"):
    return fixture(spark, d, name)


@query("""select k, nat / 100e0 national_win_rate, n2 / 100e0 national_top2_rate, loc / 100e0 local_win_rate, case when short then null else l2 / 100e0 end local_top2_rate, case when short then null else motor end motor_number,
 case when short then null else m2 / 100e0 end motor_top2_rate, case when short then null else bno end boat_number_official, case when short then null else b2 / 100e0 end boat_top2_rate,
 case when short then null when k % 4 = 0 then '123' when k % 4 = 1 then null when k % 4 = 2 then 'F12' else '123' end series_results_raw, case when short then null when k % 4 = 0 then 5 when k % 4 = 1 then 7 when k % 4 = 2 then null else 11 end early_race_number from file_lines""")
def parse_stats_line(spark, d):
    return _lines(spark, d).select("k", pages.once(of.programme_stats("stats_line")).alias("s")).select("k", "s.*")


@query("""select k, boat boat_number, reg registration_number, '山田　太郎' racer_name, age, '福岡' branch, weight, grade grade_class, nat / 100e0 national_win_rate, case when short then null else motor end motor_number from file_lines where k % 10 <> 0""")
def parse_program_b(spark, d):
    """Racers of the programme; other lines of the file are left out."""
    rows = _lines(spark, d).select("k", of.programme_racer("program_line").alias("r")).where("r is not null")
    return rows.select("k", *[f"r.{c}" for c in ("boat_number", "registration_number", "racer_name", "age", "branch", "weight", "grade_class")], "r.stats.national_win_rate", "r.stats.motor_number")


@query("""select k, case when k % 7 < 4 then 1 + k % 6 end finish_order, boat boat_number, reg registration_number, case when k % 9 = 0 then null else motor % 100 end motor_number, 660 + k % 40 as exhibition_hundredths, boat start_course,
 case k % 7 when 4 then 'DISQUALIFIED' when 5 then 'DISQUALIFIED' when 6 then 'ABSENT' else case k % 5 when 0 then 'CAPSIZED' when 1 then 'FELL' else 'FINISHED' end end finish_status, k % 7 in (5, 6) is_returned from file_lines where k % 10 <> 0""")
def parse_k_row(spark, d):
    rows = _lines(spark, d).select("k", of.result_racer("result_line").alias("r")).where("r is not null").select("k", "r.*")
    return rows.select("k", "finish_order", "boat_number", "registration_number", "motor_number", F.round(F.col("exhibition_time") * 100).cast("int").alias("exhibition_hundredths"), "start_course", "finish_status", "is_returned")


@query("select k, 1 + k % 12 race_number, case k % 2 when 0 then '予選' else '一般戦' end race_name, 1800 race_distance, case k % 3 when 0 then '晴' else '雨' end weather, '南西' wind_direction, k % 9 wind_speed, k % 11 wave_height from file_lines where k % 6 <> 0")
def parse_k_header(spark, d):
    return _lines(spark, d).select("k", of.result_header("header_line").alias("h")).where("h is not null").select("k", "h.*")


@query("""select k, case k % 5 when 0 then 'CAPSIZED' when 1 then 'FELL' when 2 then 'FINISHED' when 3 then 'PENDING' else 'ABSENT' end status from file_lines""")
def finish_status(spark, d):
    time = F.expr("case k % 5 when 0 then '転覆' when 1 then ' 落水 ' when 2 then '1.49.8' when 3 then ' ' else '' end")
    start = F.expr("case k % 5 when 3 then null when 4 then '欠場' else '0.12' end")
    return _lines(spark, d).select("k", of.finish_status(time, start).alias("status"))


@query("""select k, bet_type, combination, payout_amount, popularity, is_refund from (select k, case k % 7 when 0 then '単勝' when 1 then '複勝' when 2 then '2連単' when 3 then '3連複' when 4 then '拡連複' when 5 then '拡連複' else '2連複' end bet_type, case k % 7 when 0 then '4' when 1 then '1' when 2 then '4-1' when 3 then '1-2-3' when 4 then '1-4' when 5 then '4-5' else '特払' end combination,
 case k % 7 when 6 then 70 else 100 + k % 900 end payout_amount, case when k % 7 in (2, 3, 4, 5) then 1 + k % 20 end popularity, k % 7 = 6 is_refund from file_lines union all select k, '複勝', '2', 110, null, false from file_lines where k % 14 = 1)""")
def parse_payouts(spark, d):
    return _lines(spark, d).select("k", F.explode(of.payouts("payout_line")).alias("p")).select("k", "p.*")


@query("""select k, reg registration_number, 'B1' racer_class, age, nat / 100e0 win_rate, n2 % 1000 / 10e0 second_place_rate, case when k % 8 = 0 then null else k % 200 end first_place_count, 100 + k % 100 race_count, (10 + k % 16) / 100e0 average_start_timing, m2 / 100e0 ability_index, 2020 as "year",
 k % 50 course1_starts, k % 7 course3_third, k % 50 + 0 first_of_all, case when k % 50 = 0 then null else 100e0 end course1_first_rate, k % 7 third_place_count, concat('2020_1_', reg) as "key" from file_lines""")
def parse_term(spark, d):
    """Half-year records of fixed width, with their six blocks per course."""
    r = _lines(spark, d).select("k", pages.once(of.term_record("term_line")).alias("t")).where("t is not null")
    own = ["registration_number", "racer_class", "age", "win_rate", "second_place_rate", "first_place_count", "race_count", "average_start_timing", "ability_index", "year"]
    return r.select("k", *[f"t.{c}" for c in own], F.expr("t.courses[0].starts").alias("course1_starts"), F.expr("t.courses[2].third").alias("course3_third"), F.expr("t.courses[0].first").alias("first_of_all"), F.expr("t.courses[0].first_rate").alias("course1_first_rate"), F.expr("t.third_place_count").alias("third_place_count"), F.expr("t.key").alias("key"))


@query("select k, nat / 100e0 win_rate, case when k % 8 = 0 then null else k % 200 / 10e0 end rate from file_lines")
def parse_scaled(spark, d):
    blank = F.expr("case when k % 16 = 0 then ' - ' when k % 8 = 0 then '  ' else cast(k % 200 as string) end")
    return _lines(spark, d).select("k", text.scaled(F.col("nat").cast("string"), 100.0).alias("win_rate"), text.scaled(blank, 10.0).alias("rate"))


@query("select k % 40 as file, cast(sum(case when k % 7 = 0 then 2 else 0 end) as bigint) broken, cast(count(*) as bigint) n, sum(case when k % 7 = 0 then 2 else 0 end) > count(*) suspect from file_lines group by 1")
def dq_mojibake(spark, d):
    """Files with more replacement characters than rows."""
    broken = F.expr("case when k % 7 = 0 then concat('x', '�', 'y', '�') else 'ab' end")
    per = _lines(spark, d).select((F.col("k") % 40).alias("file"), of.broken_text(broken).alias("b")).groupBy("file").agg(F.sum("b").alias("broken"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("suspect", F.col("broken") > F.col("n"))


@query("""b as (select unnest(range(1, 7)) x), c as (select p.x b, q.x c, row_number() over (order by p.x, q.x) - 1 i from b p join b q on q.x <> p.x and p.x <> 1 and q.x <> 1)
select f.k, concat('1-', c.b, '-', c.c) combo, cast(case when (f.k + c.i) % 9 = 0 then null else (f.k * 7 + c.i * 13) % 500 + 1 end as double) odds from file_lines f cross join c where (f.k + c.i) % 9 <> 0""")
def parse_tsv_odds(spark, d):
    """Odds of the 20 trifectas of a feed line."""
    line = F.expr("concat('1\t', array_join(transform(sequence(0, 19), i -> case when (k + i) % 9 = 0 then '' else cast((k * 7 + i * 13) % 500 + 1 as string) end), '\t'))")
    return _lines(spark, d).select("k", F.explode(of.odds_of_feed(F.lit(1), line)).alias("combo", "odds"))


@query("select k, reg registration_number, case when k % 5 = 0 then null else 1 + k % 50 end as rank, case when k % 6 = 0 then null else nat / 100e0 end point_rate from file_lines where k % 7 <> 0")
def parse_standings(spark, d):
    line = F.expr("concat_ws('\t', 'x', 'y', case when k % 7 = 0 then '-' else reg end, 'a', 'b', case when k % 6 = 0 then '-' else cast(nat / 100 as string) end, case when k % 10 = 0 then '0' when k % 5 = 0 then '' else cast(1 + k % 50 as string) end)")
    return _lines(spark, d).select("k", of.standing(line).alias("s")).where("s is not null").select("k", "s.*")


@query("""s as (select k, unnest(range(0, 4)) i from file_lines) select k, cast(floor(i / 2) + 1 as int) series_day, cast(1 + (k + i) % 12 as int) race_number, cast(1 + (k + i * 5) % 6 as int) lane, cast(1 + (k + i * 7) % 6 as int) finish, case when (k + i) % 4 = 0 then null else cast(1 + (k + i * 5) % 6 as int) end start_course,
 case when (k + i) % 5 = 0 then null else cast(10 + (k + i) % 15 as double) / 100 end st from s where (k + i) % 3 <> 0""")
def season_explode(spark, d):
    slot = "concat_ws(',', cast(1 + (k + i) % 12 as string), cast(1 + (k + i * 5) % 6 as string), case when (k + i) % 4 = 0 then '' else cast(1 + (k + i * 5) % 6 as string) end, case when (k + i) % 5 = 0 then 'F' else concat('.', cast(10 + (k + i) % 15 as string)) end, translate(cast(1 + (k + i * 7) % 6 as string), '123456', '１２３４５６'))"
    packed = F.expr(f"array_join(transform(sequence(0, 3), i -> case when (k + i) % 3 = 0 then '' else {slot} end), '|')")
    return _lines(spark, d).select("k", F.explode(of.season(packed)).alias("s")).select("k", "s.*")


@query("select k, case k % 8 when 0 then 'FINISHED' when 1 then 'FELL' when 2 then 'CAPSIZED' when 3 then 'DISQUALIFIED' when 4 then 'FLYING' when 5 then 'LATE' when 6 then 'ABSENT' end status from file_lines")
def special_finish(spark, d):
    return _lines(spark, d).select("k", of.mark_status(F.expr("case k % 8 when 0 then '３' when 1 then '落' when 2 then '転' when 3 then '妨' when 4 then 'F.03' when 5 then 'L.10' when 6 then '欠' else '？' end")).alias("status"))


@query("select k, case when k % 5 = 0 then '' else concat(lpad(cast(1 + k % 12 as varchar), 2, '0'), ',', lpad(cast(13 + k % 11 as varchar), 2, '0')) end venues from file_lines")
def parse_schedule(spark, d):
    """Venues that a day's page links to."""
    html = F.expr("case when k % 5 = 0 then '<p>none</p>' else concat('<a href=\"x?jcd=', cast(13 + k % 11 as string), '\">', '<a href=\"y?jcd=', lpad(cast(1 + k % 12 as string), 2, '0'), '\">', '<a href=\"x?jcd=', cast(13 + k % 11 as string), '\">') end")
    return _lines(spark, d).select("k", F.array_join(of.venues_of_page(html), ",").alias("venues"))


@query("""select k, sha256(concat('file ', cast(k as varchar))) digest, substr(sha256(concat('file ', cast(k as varchar))), 1, 12) batch_key, '1-2-3' combination, 'AB 12' half, 'a < b & c' plain, case when k % 3 = 0 then null else 12 end lenient, concat('2020-0', 1 + k % 9, '-15') key_date, -0.05e0 exhibition,
 case when k % 2 = 0 then 109.8e0 end race_seconds, case k % 4 when 0 then '無風' when 1 then '北' when 2 then '南' else '北北西' end wind, case k % 4 when 0 then 'SEMIFINAL' when 1 then 'FINAL' when 2 then 'DREAM' else 'OTHER' end phase, case k % 4 when 0 then 'SG' when 1 then 'G1' when 2 then 'G3' else 'GENERAL' end grade,
 case when k % 3 = 0 then 'morning' when k % 3 = 1 then 'day' else 'night' end slot, cast(k % 40 - 10 as double) minutes_left, k % 40 - 10 <= 10 can_judge, case when k % 2 = 0 then 45e0 else 0e0 end clamped, k % 3 <> 0 has_three, case when k % 4 = 0 then null else cast(k % 4 as bigint) end dashed from file_lines""")
def scalar_functions(spark, d):
    """Text, key, time and presence functions of the importers on one table."""
    c, e = F.col, F.expr
    key = e("concat('file ', cast(k as string))")
    now = F.lit("2020-05-01 00:00:00").cast("timestamp")
    deadline = e("timestampadd(MINUTE, cast(k % 40 - 10 as int), timestamp'2020-05-01 00:00:00')")
    left = text.minutes_until(deadline, now)
    code = e("case k % 4 when 0 then 3 when 1 then 1 when 2 then 9 else 16 end")
    hour = e("case k % 3 when 0 then timestamp'2020-05-01 00:30:00' when 1 then timestamp'2020-05-01 03:00:00' else timestamp'2020-05-01 08:00:00' end")
    from ..functions.numbers import clamp_or_zero

    return _lines(spark, d).select(
        "k", F.sha2(key, 256).alias("digest"), F.substring(F.sha2(key, 256), 1, 12).alias("batch_key"), text.combination(F.lit(" 1 - 2　-3 ")).alias("combination"), text.half_width(F.lit("ＡＢ　１２")).alias("half"),
        text.strip_tags(F.lit("<p>a &lt; <b>b</b>\n &amp; c</p>")).alias("plain"), text.int_or_null(e("case when k % 3 = 0 then '—' else '12abc' end")).cast("int").alias("lenient"),
        text.date_of_key(e("concat('2020-0', cast(1 + k % 9 as string), '-15_01_03')")).cast("string").alias("key_date"), text.exhibition_timing(F.lit("F.05")).alias("exhibition"),
        F.round(text.race_seconds(e("case when k % 2 = 0 then '1''49\"8' else 'x' end")), 6).alias("race_seconds"), text.wind_direction(code, e("case when k % 4 = 0 then 0 else 3 end")).alias("wind"),
        text.race_phase(e("case k % 4 when 0 then '準優勝戦' when 1 then '優勝戦' when 2 then 'ドリーム戦' else '企画' end")).alias("phase"), text.grade_of(e("case k % 4 when 0 then 'ＳＧ 記念' when 1 then 'PG1' when 2 then 'G3' else '一般' end")).alias("grade"),
        text.time_slot(hour).alias("slot"), left.alias("minutes_left"), (left <= 10).alias("can_judge"), clamp_or_zero(e("case when k % 2 = 0 then '45' else 'x' end")).alias("clamped"),
        (F.size(e("case when k % 3 = 0 then array(1) else array(1, 2, 3) end")) >= 3).alias("has_three"), text.int_or_null(e("case when k % 4 = 0 then '-' else cast(k % 4 as string) end")).alias("dashed"),
    )


@query("select k, 1 + k % 12 race_number, case when k % 3 = 0 then '1-2-3' else '4-1-6' end trifecta, case when k % 4 = 0 then null else cast(1000 + k % 9000 as bigint) end payout from file_lines where k % 5 <> 0")
def parse_resultlist(spark, d):
    html = F.expr("concat('<table><tr><th>x</th></tr><tr class=\"a\"><td><a href=\"raceresult?rno=', cast(1 + k % 12 as string), '\">R</a></td>\n<td> ', case when k % 5 = 0 then '1-2' when k % 3 = 0 then '<b>1</b>-<b>2</b>-<b>3</b>' else '4-1-6' end, '</td><td>&yen;', case when k % 4 = 0 then '' else format_number(1000 + k % 9000, 0) end, '</td></tr></table>')")
    return _lines(spark, d).select("k", F.explode(of.result_list(html)).alias("r")).select("k", "r.*")


@query("select k, case when k % 6 = 0 then null else cast(1 + k % 50 as int) end as rank, reg registration_number, case when k % 7 = 0 then null else nat / 100e0 end point_rate, cast(k % 90 as double) total_points, case when k % 3 = 0 then 5e0 else 0e0 end penalty_points from file_lines where k % 10 <> 0")
def parse_pointrank(spark, d):
    row = "concat('<td>', case when k % 6 = 0 then '-' else translate(cast(1 + k % 50 as string), '0123456789', '０１２３４５６７８９') end, '</td><td><a href=\"?toban=', reg, '\">x</a></td><td>n</td><td>A1</td><td>', case when k % 7 = 0 then '-' else cast(nat / 100 as string) end, '</td><td>1 2</td><td>', cast(k % 90 as string), '</td><td>', case when k % 3 = 0 then '5' else '' end, '</td>')"
    html = F.expr(f"case when k % 10 = 0 then 'none' else concat('<tbody>\n<tr class=\"is-p10-0\">', {row}, '</tr></tbody>') end")
    ranks = _lines(spark, d).select("k", F.explode(of.point_ranks(html)).alias("r")).select("k", "r.*")
    return ranks.drop("n")


@query("select k, reg registration_number, '山田太郎' racer_name, grade grade_class, '福岡' branch, age * 1e0 age, nat / 100e0 national_win_rate, motor * 1e0 motor_number, k % 9 = 0 is_scratched, case when k % 2 = 0 then '1,2,3,.11,1|2,2,2,.10,3' else '' end season_record from file_lines")
def parse_card_feed(spark, d):
    line = F.expr("array_join(array(reg, '山田　太郎', 'x', '福岡:東京', cast(age as string), grade, case when k % 9 = 0 then '欠' else ' ' end, '', '', '.15', cast(nat / 100 as string), '', '', '', '', '', '0', cast(motor as string), '', '', '', '', '', '', '', case when k % 2 = 0 then '1,2,3,.11,1' else '' end, '', case when k % 2 = 0 then '2,2,2,.10,3' else '' end), '\t')")
    c = _lines(spark, d).select("k", of.card(line).alias("c"))
    return c.select("k", *[f"c.{n}" for n in ("registration_number", "racer_name", "grade_class", "branch", "age", "national_win_rate", "motor_number", "is_scratched", "season_record")])



def _stored(spark, parsed):
    """The tables of parsed files, which are stored once and read for each of them."""
    from ..operators.repairs import rebuilt

    return of_files.tables(rebuilt(parsed, spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")))


@query("""v as (select distinct file_name, venue_code, code, shown, m9 from day_section)
select concat('B', file_name) file, 'venue' as kind, code as key, concat_ws('|', coalesce(shown, '-'), 'シリーズ', cast(1 + m9 as varchar)) fields from v
union all select concat('B', file_name), 'race', race_key, concat_ws('|', cast(race_number as varchar), '予 選', '1800', case when shown is null then '-' else concat(shown, 'T1', cast(k % 10 as varchar), ':', lpad(cast(k % 60 as varchar), 2, '0'), ':00+09:00') end) from day_race where not odd_head
union all select concat('B', file_name), 'entry', concat(race_key, '_', cast(boat as varchar)), concat_ws('|', reg, '山田 太郎', cast(age as varchar), '福岡', cast(weight as varchar), case k % 2 when 0 then 'A1' else 'B2' end, '24', '158', '56', '5') from day_boat where not odd_head
union all select concat('B', file_name), 'error', race_key, 'no_date' from day_race where not odd_head and shown is null
union all select concat('B', file_name), 'error', race_key, 'not_six' from day_race where not odd_head and boats < 6""")
def program_files(spark, d):
    """Whole programme files: venues, races, entries and errors with the keys that stand on the lines above them."""
    t = _stored(spark, of_files.parse_program_b(_lines(spark, d, "b_lines")))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    venues = t["venues"].select("file", F.lit("venue").alias("kind"), F.col("venue_code").alias("key"), F.concat_ws("|", *map(some, ("race_date", "series_title", "series_day_number"))).alias("fields"))
    races = t["races"].select("file", F.lit("race").alias("kind"), F.col("race_key").alias("key"), F.concat_ws("|", *map(some, ("race_number", "race_name", "race_distance", "deadline_time"))).alias("fields"))
    own = ("registration_number", "racer_name", "age", "branch", "weight", "grade_class", "motor_number", "boat_number_official", "series_results_raw", "early_race_number")
    entries = t["entries"].select("file", F.lit("entry").alias("kind"), F.col("entry_key").alias("key"), F.concat_ws("|", *map(some, own)).alias("fields"))
    return venues.unionByName(races).unionByName(entries).unionByName(t["errors"].select("file", F.lit("error").alias("kind"), F.col("unit").alias("key"), F.col("rule").alias("fields")))


@query("""n as (select distinct file_name, code, shown, venue_code from day_section), b as (select * from day_boat where not odd_head and k % 29 <> 0), r as (select * from day_race where not odd_head),
p as (select r.*, x.i from r cross join (values (0), (1), (2)) x(i) where k % 29 <> 0)
select concat('K', file_name) file, 'venue' as kind, code as key, coalesce(shown, '-') fields from n
union all select concat('K', file_name), 'race', race_key, concat_ws('|', '予選', '1800', '逃げ', '晴', '南西', cast(k % 9 as varchar), cast(k % 11 as varchar), case when k % 29 = 0 then 'PENDING' else 'CONFIRMED' end) from r
union all select concat('K', file_name), 'entry', concat(race_key, '_', cast(boat as varchar)), concat_ws('|', reg, '山田太郎', cast(case when k % 31 = 0 and boat = 2 then 1 + k % 6 else 1 + (k + boat - 1) % 6 end as varchar), 'FINISHED', cast(boat as varchar), '0.12', '1.49.8') from b
union all select concat('K', file_name), 'payout', race_key, case i when 0 then concat('単勝|1|', cast(100 + k % 900 as varchar), '|-') when 1 then concat('拡連複|1-4|', cast(200 + k % 900 as varchar), '|1') else concat('拡連複|4-5|', cast(300 + k % 900 as varchar), '|7') end from p
union all select concat('K', file_name), 'unparsed', '-', 'noted' from day_race where k % 23 = 0 and k % 29 <> 0
union all select concat('K', file_name), 'error', race_key, 'no_date' from r where shown is null""")
def result_files(spark, d):
    """Whole result files: venues, races, results, payouts, errors, and the remarks among unparsed lines."""
    t = _stored(spark, of_files.parse_program_k(_lines(spark, d, "k_lines")))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))

    def part(table, kind, key, *fields):
        return t[table].select("file", F.lit(kind).alias("kind"), key.alias("key"), F.concat_ws("|", *map(some, fields)).alias("fields"))

    out = part("venues", "venue", F.col("venue_code"), "race_date").unionByName(part("races", "race", F.col("race_key"), "race_name", "race_distance", "winning_method", "weather", "wind_direction", "wind_speed", "wave_height", "result_status"))
    out = out.unionByName(part("entries", "entry", F.col("entry_key"), "registration_number", "racer_name", "finish_order", "finish_status", "start_course", "start_timing", "race_time"))
    out = out.unionByName(part("payouts", "payout", F.col("race_key"), "bet_type", "combination", "payout_amount", "popularity")).unionByName(part("errors", "error", F.col("unit"), "rule"))
    return out.unionByName(part("unparsed", "unparsed", F.lit("-"), "content").where("fields = 'noted'"))


def _boats(spark, d, *columns):
    """Boats of each race as an array of structs in order, from which a page is written.

    A stated number of partitions: pages cost far more than the few bytes of the
    boats, by whose size adaptive execution would put them into one task.
    """
    e = fixture(spark, d, "race_entry").select("race_id", "boat_number", *columns).repartition(4 * spark.sparkContext.defaultParallelism, "race_id")
    return e.groupBy("race_id").agg(F.sort_array(F.collect_list(F.struct("boat_number", *columns))).alias("boats"))  # six at most


def _cell(text, attrs='class="c" rowspan="4"'):
    return F.concat(F.lit(f"<td {attrs}>"), F.coalesce(text, F.lit("")), F.lit("</td>"))


def _number_cell(b):
    return F.concat(F.lit('<td class="is-fs14 is-boatColor" rowspan="4">'), F.translate(b["boat_number"].cast("string"), "123456", "１２３４５６"), F.lit("</td>"))


def _decimals(x, n):
    """A number of a page with ``n`` decimals; a decimal is written in a fraction of the time of ``format_string``."""
    return x.cast(f"decimal(12,{n})").cast("string")


@query("""select race_id, boat_number, registration_number, case when race_id % 5 = 0 then null else grade_class end grade_class, national_win_rate, local_win_rate, case when (race_id + boat_number) % 8 = 3 then null else motor_2rate end motor_2rate, avg_st, f_count, concat(cast(race_date as varchar), 'T1', cast(race_id % 12 % 10 as varchar), ':30:00+09:00') deadline, 'QUALIFYING' race_phase from race_entry where (race_id + boat_number) % 9 <> 4""")
def parse_racelist(spark, d):
    """Race cards: the boats whose block is whole, with missing fields, and the deadline of the race among twelve."""
    join = lambda *parts: F.concat_ws("<br>", *parts)
    two = lambda x: F.coalesce(_decimals(x, 2), F.lit("-"))

    def body(b, k):
        n = b["boat_number"]
        grade = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(" / "), b["grade_class"]))
        info = F.concat(F.lit("<div>"), b["registration_number"], grade, F.lit("</div><div><a href='#'>山田　太郎</a></div><div>福岡/福岡 <br>34歳/52.0kg</div>"))
        cells = F.concat(_cell(F.lit("photo")), _cell(info), _cell(join(F.concat(F.lit("F"), b["f_count"].cast("string")), F.lit("L0"), two(b["avg_st"]))), _cell(join(two(b["national_win_rate"]), F.lit("45.20"))), _cell(join(two(b["local_win_rate"]), F.lit("30.00"))), _cell(join(F.lit("23"), F.when((k + n) % 8 == 3, "-").otherwise(_decimals(b["motor_2rate"], 1)))), F.when((k + n) % 9 == 4, "").otherwise(_cell(F.lit("14<br>33.30"))))
        return F.concat(F.lit('<tbody class="is-fs12 x"><tr>'), _number_cell(b), cells, F.lit("</tr></tbody>"))

    rows = _boats(spark, d, "race_date", "registration_number", "grade_class", "national_win_rate", "local_win_rate", "motor_2rate", "avg_st", "f_count")
    times = "".join(f"<td>1{i % 10}:30</td>" for i in range(12))
    html = F.concat(F.lit(f'<h3 class="title16_x">予選</h3>締切予定時刻{times}'), F.array_join(F.transform("boats", lambda b: body(b, F.col("race_id"))), ""))
    read = rows.select("race_id", pages.once(pages.race_card(html, F.col("race_id") % 12 + 1, F.col("boats")[0]["race_date"])).alias("p"))
    own = ("boat_number", "registration_number", "grade_class", "national_win_rate", "local_win_rate", "motor_2rate", "avg_st", "f_count")
    return read.select("race_id", "p.deadline", "p.race_phase", F.explode("p.entries").alias("e")).select("race_id", *[f"e.{c}" for c in own], "deadline", "race_phase")


@query("""x as (select *, case when (race_id + boat_number) % 6 = 2 then null else exhibition_time end t from race_entry), c as (select *, row_number() over (partition by race_id order by (boat_number + race_id) % 6, boat_number) course from x where (race_id + boat_number) % 11 <> 5),
n as (select race_id, count(*) n from c group by 1)
select x.race_id, x.boat_number, x.t exhibition_time, case when x.t is not null then row_number() over (partition by x.race_id order by x.t nulls last, x.boat_number) end exhibition_rank, c.course entry_course, case when c.course is not null then case when x.boat_number = 3 then -x.exhibition_st else x.exhibition_st end end exhibition_st, c.course is null or x.t is null is_scratched,
 n.n >= 3 and max(x.t) over (partition by x.race_id) is not null exhibition_ready, case when x.race_id % 4 = 0 then null else '晴' end weather, case when x.race_id % 9 = 0 then '無風' else '北東' end wind_dir, cast(x.race_id % 9 as double) wind_speed from x left join c on c.race_id = x.race_id and c.boat_number = x.boat_number join n on n.race_id = x.race_id""")
def parse_beforeinfo(spark, d):
    """Warm-up pages: times and ranks, starts in the order of the courses, scratches, weather with missing parts."""
    k = F.col("race_id")

    def body(b):
        time = F.when((k + b["boat_number"]) % 6 == 2, "").otherwise(_decimals(b["exhibition_time"], 2))
        return F.concat(F.lit('<tbody class="is-fs12"><tr>'), _number_cell(b), _cell(F.lit("p")), _cell(F.lit("n")), _cell(time), _cell(F.lit("-0.5")), F.lit("</tr></tbody>"))

    def start(b):
        n = b["boat_number"].cast("string")
        st = F.concat(F.when(n == "3", "F").otherwise(""), F.substring(_decimals(b["exhibition_st"], 2), 2, 3))
        return F.concat(F.lit('<span class="table1_boatImage1Number is-type'), n, F.lit('">'), n, F.lit('</span><i></i><span class="table1_boatImage1Time is-x">'), st, F.lit("</span>"))

    rows = _boats(spark, d, "exhibition_time", "exhibition_st")
    order = F.sort_array(F.transform(F.filter("boats", lambda b: (k + b["boat_number"]) % 11 != 5), lambda b: F.struct(((b["boat_number"] + k) % 6).alias("o"), b["boat_number"].alias("n"), b.alias("b"))))
    sky = F.when(k % 4 == 0, "").otherwise('<div class="weather1_bodyUnit is-weather"><span class="weather1_bodyUnitLabelTitle">晴</span></div>')
    wind = F.concat(F.lit('<div class="weather1_bodyUnit is-windDirection"><p class="weather1_bodyUnitImage is-wind11"></p></div><span>風速</span><span class="d">'), (k % 9).cast("string"), F.lit("m</span>"))
    html = F.concat(F.array_join(F.transform("boats", body), ""), F.lit("スタート展示"), F.array_join(F.transform(order, lambda o: start(o["b"])), ""), F.lit("水面気象情報"), sky, wind)
    read = rows.select("race_id", pages.once(pages.before_info(html)).alias("p")).select("race_id", F.explode("p.entries").alias("e"), "p.exhibition_ready", "p.weather", "p.wind_dir", "p.wind_speed")
    return read.select("race_id", *[f"e.{c}" for c in ("boat_number", "exhibition_time", "exhibition_rank", "entry_course", "exhibition_st", "is_scratched")], "exhibition_ready", "weather", "wind_dir", "wind_speed")


@query("""x as (select race_id, boat_number, registration_number, case when (race_id + boat_number) % 13 = 0 then null else 1 + (boat_number + race_id) % 6 end place, 1090 + 3 * ((boat_number + race_id) % 6) + race_id % 7 tenths from race_entry),
t as (select race_id, max(tenths) filter (where place = 1) t1, max(tenths) filter (where place = 2) t2, max(tenths) filter (where place = 3) t3 from x group by 1)
select x.race_id, boat_number, registration_number, place finish, case when place is null then 'CAPSIZED' else 'FINISHED' end finish_status, case when place is not null then round(tenths / 10e0, 1) end race_time_seconds, round((t2 - t1) / 10e0, 1) margin_1_2_seconds, round((t3 - t1) / 10e0, 1) margin_1_3_seconds, 7 - boat_number start_course, case when boat_number = 2 then -0.01e0 else boat_number / 100e0 end st, '逃げ' winning_method from x join t on t.race_id = x.race_id""")
def parse_resultdetail(spark, d):
    """Result pages: places or states, race times and margins, starts by course."""
    k = F.col("race_id")

    def row(b):
        n = b["boat_number"]
        lost, place, tenths = (k + n) % 13 == 0, (n + k) % 6 + 1, 1090 + 3 * ((n + k) % 6) + k % 7
        time = F.concat(F.floor(tenths / 600).cast("string"), F.lit("'"), F.lpad(F.floor(tenths % 600 / 10).cast("string"), 2, "0"), F.lit('"'), (tenths % 10).cast("string"))
        mark = F.when(lost, "転").otherwise(F.translate(place.cast("string"), "123456", "１２３４５６"))
        who = F.concat(F.lit('<span class="is-fs12">'), b["registration_number"], F.lit('</span><span class="is-fs18 is-lh24__3rdadd">山田　太郎</span>'))
        return F.concat(F.lit("<tbody><tr>"), *[_cell(x, 'class="c"') for x in (mark, n.cast("string"), who, F.when(lost, "").otherwise(time))], F.lit("</tr></tbody>"))

    def start(b):
        n = b["boat_number"].cast("string")
        st = F.when(n == "2", "F.01").otherwise(F.concat(F.lit(".0"), n))
        return F.concat(F.lit('<span class="table1_boatImage1Number is-type'), n, F.lit('">'), n, F.lit('</span><span class="table1_boatImage1Time"><span class="table1_boatImage1TimeInner x">'), st, F.lit("</span></span>"))

    rows = _boats(spark, d, "registration_number")
    html = F.concat(F.lit("<th>レースタイム</th>"), F.array_join(F.transform("boats", row), ""), F.lit("スタート情報"), F.array_join(F.transform(F.reverse("boats"), start), ""), F.lit("勝式 決まり手 逃げ"))
    read = rows.select("race_id", pages.once(pages.result_detail(html)).alias("p"))
    f = read.select("race_id", F.explode("p.finishers").alias("f"), "p.start_info", "p.margin_1_2_seconds", "p.margin_1_3_seconds", "p.winning_method")
    own = F.filter("start_info", lambda s: s["boat_number"] == F.col("f.boat_number"))[0]
    return f.select("race_id", *[f"f.{c}" for c in ("boat_number", "registration_number", "finish", "finish_status")], F.round("f.race_time_seconds", 1).alias("race_time_seconds"), "margin_1_2_seconds", "margin_1_3_seconds", own["start_course"].alias("start_course"), own["st"].alias("st"), "winning_method")


@query("""b as (select n from (values (1), (2), (3), (4), (5), (6)) v(n)), c as (select x.n a, y.n b, z.n c from b x, b y, b z where x.n <> y.n and x.n <> z.n and y.n <> z.n)
select race_id, cast(count(*) as bigint) n, md5(string_agg(concat_ws('-', cast(a as varchar), cast(b as varchar), cast(c as varchar)) || ':' || cast(case when (race_id + a * 7 + b * 3 + c) % 19 = 0 then 0 else 10 + (race_id * 31 + a * 36 + b * 6 + c) % 5000 end as varchar), ',' order by a, b, c)) digest from race_result, c where not (race_id % 3 = 0 and a = 6 and (b = 5 and c = 4)) group by race_id""")
def parse_odds3t(spark, d):
    """Pages of all 120 odds, second boats in cells that span rows, some odds missing, some last rows broken: their number and a digest per race."""
    k = F.col("race_id")
    parts = []
    for r in range(20):
        for a in range(1, 7):
            second = [x for x in range(1, 7) if x != a]
            b = second[r // 4]
            c = [x for x in second if x != b][r % 4]
            head = ("<tr>" if a == 1 else "") + (f'<td rowspan="4">{b}</td>' if r % 4 == 0 else "") + f'<td class="x">{c}</td>'
            parts.append(F.struct(F.lit(head).alias("head"), F.lit(a * 7 + b * 3 + c).alias("gap"), F.lit(a * 36 + b * 6 + c).alias("step"), F.lit((a, b, c) == (6, 5, 4)).alias("breaks"), F.lit("</tr>" if a == 6 else "").alias("tail")))

    def group(p):
        odds = F.when((k + p["gap"]) % 19 == 0, "欠場").otherwise((((k * 31 + p["step"]) % 5000 + 10) / 10.0).cast("string"))
        return F.concat(p["head"], F.when(p["breaks"] & (k % 3 == 0), "").otherwise(_cell(odds, 'class="oddsPoint"')), p["tail"])

    # a list of constants and not 120 expressions, which are too much code for one method
    html = F.concat(F.lit('<tbody class="is-p3-0">'), F.array_join(F.transform(F.array(*parts), group), ""), F.lit("</tbody>"))
    # the page is a column of its own before it is read
    written = fixture(spark, d, "race_result").select("race_id", html.alias("html"))
    read = written.select("race_id", pages.once(pages.odds_grid("html")).alias("odds"))
    told = F.sort_array(F.transform("odds", lambda o: F.concat(o["combo"], F.lit(":"), (o["odds"] * 10 + 0.5).cast("long").cast("string"))))
    return read.select("race_id", F.size("odds").cast("long").alias("n"), F.md5(F.array_join(told, ",")).alias("digest"))


@query("""select race_id, cast(race_date - cast(race_id % 4 as int) as date) series_start_date, cast(race_date - cast(race_id % 4 as int) + 3 as date) series_end_date, cast(race_id % 4 + 1 as int) series_day, race_id % 4 = 3 is_final_day, case race_id % 3 when 0 then 'SG' when 1 then 'G1' else 'GENERAL' end grade from race""")
def series_year_infer(spark, d):
    """Days of a series that stand as month and day on the page of each race, dated around it."""
    day = lambda n: F.date_add(F.date_sub("race_date", (F.col("race_id") % 4).cast("int")), n)
    item = lambda n, name: F.concat(F.lit("<li><a>"), F.month(day(n)).cast("string"), F.lit("月"), F.dayofmonth(day(n)).cast("string"), F.lit(f"日 {name}</a></li>"))
    kind = F.when(F.col("race_id") % 3 == 0, "is-SGa").when(F.col("race_id") % 3 == 1, "is-G1b").otherwise("is-ippan")
    html = F.concat(F.lit('<div class="heading2_title '), kind, F.lit('"><h2 class="heading2_titleName">x</h2></div><ul class="tab2 is-type1">'), *[item(n, name) for n, name in enumerate(("初日", "２日目", "３日目", "最終日"))], F.lit("</ul>"))
    read = fixture(spark, d, "race").select("race_id", pages.once(pages.series_context(html, "race_date")).alias("s"))
    return read.select("race_id", "s.series_start_date", "s.series_end_date", "s.series_day", "s.is_final_day", "s.grade")


@query("""select race_date, venue_code, cast(race_number as int) race_number, concat(cast(race_date as varchar), 'T1', cast(race_number % 10 as varchar), ':15:00+09:00') deadline, case when race_number % 2 = 0 then 6 else 0 end racers from race group by all""")
def parse_day_page(spark, d):
    """Schedule and card table of every venue's day: deadlines, and the races whose six racers are named."""
    r = fixture(spark, d, "race").select("race_date", "venue_code", "race_number").distinct()

    def row(n):
        racers = F.array_join(F.transform(F.sequence(F.lit(1), F.when(n % 2 == 0, 6).otherwise(5)), lambda b: F.concat(F.lit("<td><a href='/racersearch/profile?toban="), (b + 4000).cast("string"), F.lit("'>山田</a><br>A1</td>"))), "")
        return F.concat(F.lit("<tr><td><a href='racelist?rno="), n.cast("string"), F.lit("'>x</a></td><td> 1"), (n % 10).cast("string"), F.lit(":15 </td>"), racers, F.lit("</tr>"))

    page = r.groupBy("race_date", "venue_code").agg(F.sort_array(F.collect_list("race_number")).alias("n")).select("race_date", "venue_code", F.array_join(F.transform("n", row), "").alias("html"))  # twelve races at most
    read = page.select("race_date", "venue_code", pages.day_schedule("html", "race_date").alias("s"), pages.card_table("html").alias("t"))
    each = read.select("race_date", "venue_code", F.explode("s").alias("r"), "t")
    own = F.try_element_at(F.filter("t", lambda x: x["race_number"] == F.col("r.race_number")), F.lit(1))["racers"]
    return each.select("race_date", "venue_code", "r.race_number", "r.deadline", F.when(own.isNotNull(), F.size(own)).otherwise(0).alias("racers"))
