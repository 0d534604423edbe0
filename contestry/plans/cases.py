"""Scalar functions over written-out cases: row k of customer takes case k modulo their number.

The twins don't repeat a function's logic: they hold the values that each case must give, read from the survey.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestry.functions import names
from contestry.functions import scalar as sc
from contestry.functions import text
from contestry.operators import audit
from contestry.plans.registry import query
from contestry.sources.proxy import table


def literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, dt.datetime):
        return f"'{x}'"
    if isinstance(x, dt.date):
        return f"DATE '{x}'"
    if isinstance(x, list):
        return "[" + ", ".join(map(literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else repr(x)


def cases(name: str, f: Callable[..., dict[str, Column]], kinds: str, rows: list[tuple]) -> None:
    """rows: a case's inputs and, behind them, the values of f's columns. kinds: Spark types of the inputs, then DuckDB types of the values."""
    types, results = (part.split() for part in kinds.split("->"))
    n = len(types)

    def run(spark, d) -> DataFrame:
        given = spark.createDataFrame([(i, *r[:n]) for i, r in enumerate(rows)], "case_ int, " + ", ".join(f"x{i} {t}" for i, t in enumerate(types)))
        # The inputs are broadcast, not the results: the function runs over the table's rows.
        dealt = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % len(rows)).cast("int").alias("case_")).join(F.broadcast(given), "case_")
        return dealt.select("c_custkey", *[c.alias(k) for k, c in f(*[F.col(f"x{i}") for i in range(n)]).items()])

    run.__name__ = name
    wanted = [f"list_extract([{', '.join(literal(r[n + j]) for r in rows)}]::{t}[], (c_custkey % {len(rows)} + 1)::INT)" for j, t in enumerate(results)]
    labels = f.columns  # type: ignore[attr-defined]
    query("SELECT c_custkey, " + ", ".join(f"{w} AS {c}" for w, c in zip(wanted, labels, strict=True)) + " FROM customer")(run)


def gives(*columns: str):
    def mark(f):
        f.columns = columns
        return f

    return mark


def one(f: Callable[..., Column], column: str = "result"):
    return gives(column)(lambda *x: {column: f(*x)})


cases("name_keys", gives("normal", "casefolded", "folded", "key")(lambda a: {"normal": text.normal_name(a), "casefolded": text.casefold_name(a), "folded": text.fold_name(a), "key": text.duplicate_key(a)}), "string -> VARCHAR VARCHAR VARCHAR VARCHAR", [
    ("  St-Pierre  Georges ", "st pierre georges", "st-pierre georges", "st pierre georges", "st-pierre georges"),
    ("T.J. Straße", "t j strasse", "t.j. strasse", "t j strasse", "t.j. strasse"),
    ("Jiří Procházka", "jiří procházka", "jiří procházka", "jiri prochazka", "jiri prochazka"),
    (None, None, None, None, None), ("", "", "", "", ""),
])
cases("subset_names", one(names.subset_match), "string string -> BOOLEAN", [
    ("Jose Delgado", "Jose Miguel Delgado", True), ("José Silva Lima", "Jose Lima Silva", True), ("Delgado", "Jose Delgado", False), ("da Silva", "Joao da Silva", False),
    ("T.J.", "T.J. Dillashaw", False), ("le du", "le du Bois", False), ("Anna Maria Li", "Anna Li", True), ("Anna Li", "Anne Li", False), ("Jon Jones Jr", "Jon Jones", True), (None, "a b", None),
])
cases("diminutives", one(names.diminutive_match), "string string -> BOOLEAN", [
    ("Zach Reese", "Zachary Reese", True), ("Zachary Reese", "Zach Reese", True), ("Jon Jones", "Jonathan Jones", False), ("Alex Silva", "Alex Silva", False), ("Marcos Silva", "Marcos Silveira", False),
    ("José Aldo", "Josefino Aldo", True), ("Zach", "Zachary", False), ("Alex da Silva", "Alexander da Silva", True), (None, "x y", None),
])
cases("corner_of_name", one(names.corner_of), "string string string -> VARCHAR", [
    ("Jose Delgado", "Jose Miguel Delgado", "Austin Bashi", "red"), ("AUSTIN BÀSHI", "Jose Miguel Delgado", "Austin Bashi", "blue"), ("Zach Reese", "Sedriques Dumas", "Zachary Reese", "blue"),
    ("Jose Delgado", "Jose Miguel Delgado", "Jose Luis Delgado", None), ("Bruno Silva", "Bruno Silva", "Bruno Silva", "red"), ("Nobody Else", "A B", "C D", None), ("Zach Reese", "Zachary Reese", "Zachariah Reese", None),
])
cases("measures", gives("height", "reach", "grams", "number")(lambda a: {"height": names.height_cm(a), "reach": names.reach_cm(a), "grams": names.weight_grams(a), "number": names.whole_number(a)}), "string -> DOUBLE DOUBLE BIGINT BIGINT", [
    ("5' 11\"", 180.34, 12.7, 2268, 5), ("5’ 11”", 180.34, 12.7, 2268, 5), ("6′2″", 187.96, 15.24, 2722, 6), ("155", None, 393.7, 70307, 155), ("155 lbs.", None, 393.7, 70307, 155),
    ("--", None, None, None, None), (None, None, None, None, None), ("N/A", None, None, None, None), (" -3 ", None, 7.62, 1361, -3), ("72\"", None, 182.88, 32659, 72), ("no digits", None, None, None, None),
])
cases("records", gives("wins", "losses", "draws", "landed", "attempted", "seconds")(lambda a: {**{c: names.record_parts(a)[c] for c in ("wins", "losses", "draws")}, **{c: names.landed_attempted(a)[c] for c in ("landed", "attempted")}, "seconds": names.control_seconds(a)}), "string -> INTEGER INTEGER INTEGER BIGINT BIGINT BIGINT", [
    ("Record: 20-3-1 (1 NC)", 20, 3, 1, None, None, None), ("12 - 4", 12, 4, 0, None, None, None), (None, 0, 0, 0, None, None, None), ("12 of 34", 0, 0, 0, 12, 34, None), ("7  OF 9", 0, 0, 0, 7, 9, None),
    ("4:59", 0, 0, 0, None, None, 299), ("1:02:03", 0, 0, 0, None, None, 3723), ("--", 0, 0, 0, None, None, None), ("4:59 x", 0, 0, 0, None, None, None),
])
cases("dates_read", one(names.any_date), "string -> DATE", [
    ("Jan 5, 2024", dt.date(2024, 1, 5)), ("January 05, 2024", dt.date(2024, 1, 5)), ("2024-01-05", dt.date(2024, 1, 5)), ("  May 7,  2023 ", dt.date(2023, 5, 7)), ("5 Jan 2024", None), (None, None), ("--", None), ("Feb 30, 2024", None),
])
cases("unknown_values", gives("measure", "stance")(lambda a, b: {"measure": names.known_measure(a), "stance": sc.stance(b)}), "double string -> DOUBLE VARCHAR", [
    (0.0, "--", None, None), (71.5, "Orthodox", 71.5, "Orthodox"), (None, None, None, None), (1.0, " N/A ", 1.0, None), (2.0, "", 2.0, None),
])
cases("external_methods", one(sc.external_method), "string string -> VARCHAR", [
    ("decision---unanimous", "Decision", "U-DEC"), ("unanimous-decision", None, "U-DEC"), ("decision---split", "", "S-DEC"), ("decision---majority", "x", "M-DEC"), ("decision", "Technical Decision", "Technical Decision"), ("decision", None, "Decision"),
    ("kotko", "KO", "KO/TKO"), ("tko---doctors-stoppage", "TKO", "KO/TKO - Doctors Stoppage"), ("tko", "TKO (Punches)", "KO/TKO"), ("ko-punch", "KO (Punch)", "KO/TKO - Punch"),
    ("submission", None, "SUB"), ("submission-anaconda-choke", None, "SUB - Anaconda Choke"), ("submission", "Submission (Rear Naked Choke)", "SUB - Rear Naked Choke"),
    ("no-contest", "x", "CNC"), ("disqualification", "x", "DQ"), ("strange", "Strange End", "Strange End"), (None, None, None), ("", " ", None),
])
cases("provisional_methods", gives("method", "cancelled", "suspended")(lambda a, b: {"method": sc.provisional_method(a), "cancelled": sc.is_cancelled(b), "suspended": sc.is_suspended(b)}), "string string -> VARCHAR BOOLEAN BOOLEAN", [
    ("decision---split", "STATUS_FINAL", "Decision", False, False), ("kotko", "STATUS_CANCELED", "KO/TKO", True, False), ("tko", "STATUS_SUSPENDED", "KO/TKO", True, True), ("SUBMISSION", "postponed", "Submission", True, False),
    ("dq", None, None, False, False), ("", "STATUS_IN_PROGRESS", None, False, False), (None, "STATUS_FORFEIT", None, True, False),
])
cases("weight_classes", gives("kg", "female")(lambda a: {"kg": sc.weight_class_kg(a)["kg"], "female": sc.weight_class_kg(a)["female"]}), "string -> DOUBLE DOUBLE", [
    ("Lightweight", 70.3, 0.0), ("Women's Strawweight", 52.2, 1.0), ("Women’s Flyweight", 56.7, 1.0), ("Light Heavyweight", 93.0, 0.0), ("Catch Weight", None, 0.0), ("Women Featherweight", 65.8, 1.0), ("  ", None, None), (None, None, None), ("Heavyweight", 120.2, 0.0),
])
cases("eras", one(sc.era), "int -> VARCHAR", [(1995, "1995-2004"), (2004, "1995-2004"), (2005, "2005-2009"), (2014, "2010-2014"), (2019, "2015-2019"), (2020, "2020-2024"), (2025, "2025+"), (None, None)])
cases("published_dates", one(lambda a: sc.published_at(a).cast("string")), "string -> VARCHAR", [
    ("Tue, 03 Mar 2026 10:00:00 GMT", dt.datetime(2026, 3, 3, 10)), ("mar, 03 Mar 2026 10:00:00 +0100", dt.datetime(2026, 3, 3, 9)), ("lun, 12 ene 2026 08:30:00 +0000", dt.datetime(2026, 1, 12, 8, 30)), ("sáb, 1 ago 2026 23:00:00 -0200", dt.datetime(2026, 8, 2, 1)), ("yesterday", None), (None, None),
])
cases("label_dates", one(sc.label_date), "string timestamp -> DATE", [
    ("Sat, Jun 20 / 8:00 PM EDT", dt.datetime(2026, 6, 21), dt.date(2026, 6, 20)), ("Wed, Dec 31 / 8:00 PM EST", dt.datetime(2027, 1, 1, 1), dt.date(2026, 12, 31)), ("Fri, Jan 1 / 1:00 AM EST", dt.datetime(2026, 12, 31, 23), dt.date(2027, 1, 1)), ("soon", dt.datetime(2026, 1, 1), None), (None, dt.datetime(2026, 1, 1), None),
])
cases("event_names", gives("overlap")(lambda a, b: {"overlap": sc.event_overlap(text.strip_accents(a), text.strip_accents(b)).cast("long")}), "string string -> BIGINT", [
    ("UFC Fight Night: Procházka vs. Hill", "UFC on ESPN: Prochazka vs Hill", 2), ("UFC 300", "UFC 300: Pereira vs Hill", 1), ("UFC Fight Night", "Fight Night", 0), ("Silva vs Silva", "Silva vs Costa", 1), ("", "x", 0),
])
cases("places", gives("tokens", "found")(lambda a, b: {"tokens": F.array_join(F.array_sort(sc.place_tokens(text.strip_accents(a))), " "), "found": sc.title_has_place(text.strip_accents(b), sc.place_tokens(text.strip_accents(a)))}), "string string -> VARCHAR BOOLEAN", [
    ("Belgrade Arena, BG, Serbia", "UFC Belgrade Faceoffs", "belgrade serbia", True), ("London, England, United Kingdom", "Londoners face off", "england london", False), ("UFC Apex, Las Vegas, Nevada, USA", "UFC Vegas 99: Face-Offs", "apex nevada vegas", True),
    ("Rio de Janeiro, Brazil", "UFC Río", "brazil janeiro rio", True), ("National Gymnastics Arena, Baku, Azerbaijan", "national faceoff", "azerbaijan baku", False),
])
cases("news", gives("category", "relevance")(lambda a, b: {"category": sc.news_category(a), "relevance": sc.relevance(sc.news_category(a), b)}), "string bigint -> VARCHAR INTEGER", [
    ("Jones vs Aspinall booked", 1, "fight_announcement", 95), ("Jones DEFEATS Miocic", None, "fight_result", 65), ("Star is injured", 2, "injury", 95), ("New rankings are in", None, "ranking_change", 55), ("He signs a deal", 3, "transfer", 85), ("She talks", None, "interview", 55), ("All about it", None, "fight_announcement", 65), ("Nothing here", 4, "other", 80), (None, None, "other", 50),
])
cases("pictures", gives("ok", "id", "domain")(lambda a: {"ok": sc.headshot_ok(a, "a.example.com", "/i/headshots/players/"), "id": sc.url_id(a), "domain": sc.url_domain(a)}), "string -> BOOLEAN VARCHAR VARCHAR", [
    ("https://a.example.com/i/headshots/players/full/123.png", True, "123", "a.example.com"), ("https://www.other.org/i/headshots/players/9.jpg?x=1", False, "9", "other.org"), ("HTTP://A.EXAMPLE.COM/I/Headshots/Players/x.png", True, None, "a.example.com"), (None, None, None, "(blank)"), ("", False, None, "(blank)"),
])
cases("places_listed", gives("tokens", "martial", "website", "address")(lambda a, b, c, d: {"tokens": F.array_join(sc.list_tokens(a), "|"), "martial": F.array_join(sc.martial_tokens(a), "|"), "website": sc.website(b), "address": sc.address(c, d, F.lit("08001"), F.nullif(d, d))}), "string string string string -> VARCHAR VARCHAR VARCHAR VARCHAR", [
    ("Boxing; fitness,judo", "gym.example;x", "Main St", "5", "boxing|fitness|judo", "boxing|judo", "https://gym.example", "Main St, 5, 08001"), (None, None, None, None, "", "", None, "08001"), ("yoga", "HTTP://A.b", "", "7", "yoga", "", "HTTP://A.b", "08001"), ("k1", " ; ", "X", "", "k1", "k1", None, "X, 08001"),
])
cases("photos", gives("red_source", "red_mirror", "blue_source")(lambda a, b, c, d: {"red_source": sc.corner_photo("L", a, b, c, d)["source"], "red_mirror": sc.corner_photo("L", a, b, c, d)["mirror"], "blue_source": sc.corner_photo("R", a, b, c, d)["source"]}), "string string string string -> VARCHAR BOOLEAN VARCHAR", [
    ("l", "r", "s", "f", "exact", False, "exact"), (None, "r", "s", "f", "opposite", True, "exact"), ("l", " ", None, None, "exact", False, "opposite"), (None, None, "x_R_1.png", None, "legacy", True, "legacy"), (None, None, None, "x_L_1.png", "full", False, "full"), (None, None, "", " ", None, None, None),
])
cases("night_states", one(sc.night_status), "bigint bigint bigint double -> VARCHAR", [
    (5, 10, 10, 99.0, "ENDED"), (5, 10, 9, 2.0, "OK"), (0, 10, 9, 2.0, "DOWN"), (5, 10, 9, 11.0, "DOWN"), (5, 10, 9, None, "OK"), (0, 0, 0, None, "DOWN"), (3, 0, 0, None, "OK"),
])
cases("show_starts", one(lambda *x: sc.show_start(*x).cast("string")), "timestamp timestamp timestamp -> VARCHAR", [
    (dt.datetime(2026, 1, 1, 18), dt.datetime(2026, 1, 1, 20), dt.datetime(2026, 1, 1, 22), dt.datetime(2026, 1, 1, 18)), (None, dt.datetime(2026, 1, 1, 20), dt.datetime(2026, 1, 1, 22), dt.datetime(2026, 1, 1, 20)), (None, None, dt.datetime(2026, 1, 1, 22), dt.datetime(2026, 1, 1, 18)), (None, None, None, None),
])
cases("promotions", one(lambda a, b, c: sc.promotion(a, b, c, {"3323": "Bellator"})), "string string string -> VARCHAR", [
    ("3323", "X 1: A vs B", None, "Bellator"), ("1", "Cage Warriors 150: A vs B", None, "Cage Warriors"), ("1", "Tech-Krep FC - Ermak Prime Challenge", None, "Tech-Krep FC"), ("1", "Long name", "LFA 99", "LFA"), ("1", None, None, "Regional"), ("1", "Rizin 40", None, "Rizin"),
])
cases("event_titles", gives("same")(lambda a, b: {"same": sc.same_event_title(text.strip_accents(a), text.strip_accents(b))}), "string string -> BOOLEAN", [
    ("UFC 300: Pereira vs Hill", "UFC 300", True), ("UFC 300", "UFC 301", False), ("Fight Night: Condit vs Kampmann 2", "Condit vs. Kampmann 2", True), ("Condit vs Kampmann", "Condit vs Kampmann 2", False), ("Cowboy vs Cowboy", "Cowboy vs Edwards", False),
    ("Blaydes vs Dos Santos", "Junior dos Santos", False), ("Fight for the Troops", "Fight for the Troops", False), ("Belfort vs. Henderson III", "Belfort vs Henderson 3", True), (None, "x", False),
])
cases("one_person", gives("same", "verified")(lambda a, b, c: {"same": text.one_person(a, b), "verified": text.identity_guard(a, b, c)}), "string string boolean -> BOOLEAN BOOLEAN", [
    ("Jan Błachowicz", "Jan Blachowicz", False, True, True), ("Weili Zhang", "ZHANG Weili", True, True, True), ("José Aldo Jr.", "Jose Aldo", True, True, True), ("Jose Aldo", "Jose Torres", True, False, False), ("Jose Aldo", None, True, False, True), ("Jose Aldo", None, False, False, False), ("?", "x", True, False, False),
])
cases("doubtful_names", gives("suspicious", "name")(lambda a: {"suspicious": text.suspicious_name(a), "name": text.capitalised_run(a)}), "string -> BOOLEAN VARCHAR", [
    ("Jose Aldo", False, "Jose Aldo"), ("Descarga gratis Jose da Silva mp3", True, "Jose da Silva"), ("free VIDEO", True, None), ("Aldo", False, None), (None, None, None), ("Jon Jones (UFC) | pdf", True, "Jon Jones"), ("x" * 41, True, None),
])
cases("result_known", gives("has", "near", "corner")(lambda a, b, c: {"has": sc.has_result(a, b), "near": sc.within_days(c, F.lit("2026-01-10").cast("date"), 3, 1), "corner": sc.kept_corner(a, F.lit(9), F.lit(9), a)}), "bigint string date -> BOOLEAN BOOLEAN BIGINT", [
    (1, None, dt.date(2026, 1, 7), True, True, 1), (None, "Draw", dt.date(2026, 1, 11), True, True, 9), (None, None, dt.date(2026, 1, 6), False, False, 9), (4, "KO", dt.date(2026, 1, 12), True, False, 4),
])
cases("rounds_and_ages", gives("rounds", "age", "total")(lambda a, b: {"rounds": sc.scheduled_rounds(a), "age": sc.age_years(b, F.lit("2026-01-01").cast("date")), "total": sc.pair_sum(F.col("x0").try_cast("int"), F.year(b))}), "string date -> INTEGER DOUBLE DOUBLE", [
    ("5", dt.date(1996, 1, 1), 5, 30.0014, 2001.0), ("x", dt.date(2000, 6, 1), 3, 25.5852, None), ("-1", None, 3, None, None), (None, dt.date(2025, 12, 31), 3, 0.0027, None),
])
cases("headshots", one(lambda a, b: audit.caption_matches(a, b)), "string string -> BOOLEAN", [
    ("Jiří Procházka", "Jiri Prochazka", True), ("Jon Jones", "Jon Jone", True), ("Jon Jones", "Tom Aspinall", False), ("Alex Pereira", "alex-pereira", True), (None, "x", None), ("Weili Zhang", "Zhang Weili", False),
])
