"""Queries on pages, feeds and documents that are written from the tables' numbers, so that the twins know what must be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestry.plans.registry import query
from contestry.sources import feeds, pages
from contestry.sources.proxy import table


def order_key():
    return F.col("o_orderkey")


def customer_key():
    return F.col("o_custkey")


def orders(spark, d, html):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    # A small file is one task; its rows are dealt out before they become pages.
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey").select("o_orderkey", html.alias("html"))


def say(pattern: str, *cols):
    return F.format_string(pattern, *cols)


CARD = """<html><body><table><thead><tr><th>W/L</th></tr></thead><tbody>
<tr data-link="http://x/fight-details/f%d"><td><a class="b-flag"><i class="b-flag__text">%s</i></a></td><td><p><a href="http://x/fighter-details/z%d">Win &amp; Ner</a><p><a href="http://x/fighter-details/a%d">Los  Er</a></td>
<td>-<td>-<td>-<td>-<td><p>Lightweight %s</p></td><td><p>SUB</p><p>%s</p></td><td><p>%d</p></td><td><p>4:%02d</p></td></tr>
<tr data-link="http://x/fight-details/f%d"><td>again</td></tr><tr><td>no link</td></tr></tbody></table></body></html>"""


@query("""SELECT o_orderkey, 1 AS position, 'a' || o_custkey red_source, 'Los Er' red_name, 'z' || o_orderkey blue_source, 'Win & Ner' blue_name, CASE WHEN o_orderkey % 3 > 0 THEN 'z' || o_orderkey END winner_source, 'Lightweight' weight_class,
  CASE WHEN o_orderkey % 2 = 0 THEN 'SUB - Choke' ELSE 'SUB' END AS method, CAST(1 + o_orderkey % 5 AS INT) end_round, '4:' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') end_time, 'f' || o_orderkey detail, o_custkey % 4 = 0 is_title FROM orders""")
def html_event_card(spark, d):
    html = say(CARD, order_key(), F.when(order_key() % 3 > 0, "win").otherwise("draw"), order_key(), customer_key(), F.when(customer_key() % 4 == 0, '<img src="belt.png">').otherwise('<img src="perf.png">'), F.when(order_key() % 2 == 0, "Choke").otherwise(""), 1 + order_key() % 5, customer_key() % 60, order_key())
    return pages.extract(orders(spark, d, html), "o_orderkey", "html", pages.event_card, pages.CARD)


HEAD = '<table class="b-fight-details__table js"><thead><tr><th>Fighter</th><th>KD</th></tr></thead><tbody>'
ROW = "<tr><td><p><a href='/fighter-details/r%d'>Red</a></p><p><a href='/fighter-details/b%d'>Blue</a></p></td><td><p>%d</p><p>0</p></td><td><p>%d of %d</p><p>%d of 50</p></td><td></td><td></td><td><p>1 of 2</p><p>---</p></td><td></td><td><p>%d</p><p>1</p></td><td></td><td><p>%d:%02d</p><p>--</p></td></tr>"


def fight_page(marked):
    row = lambda n: say(ROW, order_key(), customer_key(), order_key() % 3, order_key() % 30 + n, order_key() % 30 + 10, customer_key() % 20 + n, customer_key() % 4, customer_key() % 5, order_key() % 60)
    mark = lambda n: F.lit(f'<thead class="b-fight-details__table-row_type_head"><tr><th>Round {n}</th></tr></thead>') if marked else F.lit("")
    return F.concat(F.lit("<html>" + HEAD), mark(1), row(1), mark(2), row(2), F.lit("</tbody></table></html>"))


@query("""SELECT o_orderkey, 'r' || o_orderkey source, 'Red' AS name, CAST(2 * (o_orderkey % 30) + 3 AS INT) sig_landed, CAST(2 * (o_orderkey % 30 + 10) AS INT) sig_attempted, 2 td_landed, 4 td_attempted, CAST(2 * (o_custkey % 4) AS INT) subs, CAST(2 * ((o_custkey % 5) * 60 + o_orderkey % 60) AS INT) AS control, CAST(2 * (o_orderkey % 3) AS INT) knockdowns FROM orders
  UNION ALL SELECT o_orderkey, 'b' || o_custkey, 'Blue', CAST(2 * (o_custkey % 20) + 3 AS INT), 100, NULL, NULL, 2, NULL, 0 FROM orders""")
def html_fight_totals(spark, d):
    return pages.extract(orders(spark, d, fight_page(False)), "o_orderkey", "html", pages.fight_totals, pages.TOTALS)


@query("""SELECT o_orderkey, 'r' || o_orderkey source, 'Red' AS name, n AS round, CAST(o_orderkey % 30 + n AS INT) sig_landed, CAST(o_orderkey % 30 + 10 AS INT) sig_attempted, 1 td_landed, 2 td_attempted, CAST(o_custkey % 4 AS INT) subs, CAST((o_custkey % 5) * 60 + o_orderkey % 60 AS INT) AS control, CAST(o_orderkey % 3 AS INT) knockdowns FROM orders, (VALUES (1), (2)) v(n) WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'b' || o_custkey, 'Blue', n, CAST(o_custkey % 20 + n AS INT), 50, NULL, NULL, 1, NULL, 0 FROM orders, (VALUES (1), (2)) v(n) WHERE o_orderkey % 2 = 0""")
def html_fight_rounds(spark, d):
    html = F.when(order_key() % 2 == 0, fight_page(True)).otherwise(fight_page(False))
    return pages.extract(orders(spark, d, html), "o_orderkey", "html", pages.fight_rounds, pages.ROUNDS)


PERSONS = "<div class='b-fight-details__person'><i class='b-fight-details__person-status x'>%s</i><a href='/fighter-details/p%d'>One</a></div><div class='b-fight-details__person'><i class='b-fight-details__person-status'>%s</i><a href='/fighter-details/q%d'>Two</a></div>"
CARDS = "<p class='b-fight-details__text'><i class='b-fight-details__text-item'><i class='b-fight-details__label'>Referee:</i> <span>Big  Ref</span></i></p><p class='b-fight-details__text'><i class='b-fight-details__text-item'><span>Judge A</span> 27 - %d.</i><i class='b-fight-details__text-item'><span>Judge B</span> 28 - 29.</i></p>"


@query("""WITH t AS (SELECT o_orderkey k, o_custkey c, o_orderkey % 3 w, CAST(28 + o_orderkey % 3 AS INT) s FROM orders), j AS (SELECT 'Judge A' judge, 27 l UNION ALL SELECT 'Judge B', 28)
  SELECT k o_orderkey, 'Big Ref' referee, judge, 'p' || k red_source, CASE WHEN w = 0 THEN CASE judge WHEN 'Judge A' THEN s ELSE 29 END ELSE l END red_score, 'q' || c blue_source, CASE WHEN w = 0 THEN l ELSE CASE judge WHEN 'Judge A' THEN s ELSE 29 END END blue_score FROM t, j WHERE w < 2
  UNION ALL SELECT k, 'Big Ref', NULL, NULL, NULL, NULL, NULL FROM t WHERE w = 2""")
def html_officials(spark, d):
    w = order_key() % 3
    html = F.concat(say(PERSONS, F.when(w == 0, "W").otherwise("L"), order_key(), F.when(w == 1, "W").otherwise("L"), customer_key()), say(CARDS, 28 + w))
    return pages.extract(orders(spark, d, html), "o_orderkey", "html", pages.officials, pages.OFFICIALS)


BLOCK = "<div class='view-grouping'><div class='view-grouping-header'>Women's Flyweight Top Rank</div><div class='rankings--athlete--champion'><div class='info'><h5><a>%s</a></h5></div></div><table><tbody>%s</tbody></table></div>"
RANKED = "<tr><td class='views-field-weight-class-rank'>%d</td><td class='views-field views-field-title'><a>N %d</a></td><td class='views-field-weight-class-rank-change'>%s</td></tr>"


@query("""SELECT o_orderkey, 'women_s_flyweight' division, 'Champ ' || o_custkey champion, CAST(i AS INT) AS rank, 'N ' || (o_orderkey + i) AS name, CASE i WHEN 1 THEN CAST(o_custkey % 3 + 1 AS INT) WHEN 2 THEN -2 END change, i = 2 AND o_orderkey % 2 = 0 mismatch FROM orders, (VALUES (1), (2)) v(i)""")
def html_rankings(spark, d):
    rows = F.concat(say(RANKED, F.lit(1), order_key() + 1, say("Rank increased by %d", customer_key() % 3 + 1)), say(RANKED, F.when(order_key() % 2 == 0, 1).otherwise(2), order_key() + 2, F.lit("Rank decreased by 2")))
    html = F.concat(say(BLOCK, say("Champ %d", customer_key()), say(RANKED, F.lit(1), order_key(), F.lit(""))), say(BLOCK, F.lit(""), rows))
    return pages.extract(orders(spark, d, html), "o_orderkey", "html", pages.rankings, pages.RANKINGS)


@query("""SELECT o_orderkey, 'FOTN' kind, 'A ' || o_orderkey name_1, 'B ' || o_custkey name_2 FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 'POTN', unnest(['C ' || o_custkey, 'D', 'E']), NULL FROM orders WHERE o_orderkey % 4 > 0""")
def html_bonuses(spark, d):
    list_ = say("<ul><li><b>Fight of the Night:</b> A %d vs. B %d<sup>[ 3 ]</sup></li><li>Performance of the Night: C %d, D and E</li><li>Other: X</li></ul>", order_key(), customer_key(), customer_key())
    html = F.concat(F.lit("<ul><li>Fight of the Night: No vs. One</li></ul>"), F.when(order_key() % 4 > 0, "<h2><span>Bonus awards</span></h2><p>text</p>").otherwise("<h2>Results</h2>"), list_)
    return pages.extract(orders(spark, d, html), "o_orderkey", "html", pages.bonuses, pages.BONUSES)


@query("SELECT o_orderkey, 'http://x/event-details/e' || o_orderkey url, 'Event ' || o_custkey AS name, 'June 06, 2020' AS day, 'Las Vegas, USA' AS location FROM orders")
def html_events_index(spark, d):
    row = say("<tr><td><i><a href='http://x/event-details/e%d'>Event %d</a><span class='b-statistics__date'> June 06, 2020</span></i></td><td>Las  Vegas, USA</td></tr>", order_key(), customer_key())
    return pages.extract(orders(spark, d, F.concat(F.lit("<table><tbody><tr><td></td></tr>"), row, row, F.lit("</tbody></table>"))), "o_orderkey", "html", pages.events_index, pages.INDEX)


@query("SELECT o_orderkey, 'h' || o_custkey source, 'Ann' AS first, 'Lee' || o_orderkey AS last, '5'' 4\"' AS height, '115 lbs.' AS weight, 'Southpaw' AS stance, CAST(o_orderkey % 20 AS INT) wins, CAST(o_custkey % 9 AS INT) losses, 0 draws FROM orders")
def html_fighters_index(spark, d):
    cell = lambda x: f"<td><a href='http://x/fighter-details/h%d'>{x}</a></td>"
    row = say("<tr>" + cell("Ann") + cell("Lee%d") + "<td></td><td>5' 4\"</td><td>115 lbs.</td><td>64\"</td><td>Southpaw</td><td>%d</td><td>%d</td><td>0</td><td></td></tr>", customer_key(), customer_key(), order_key(), order_key() % 20, customer_key() % 9)
    return pages.extract(orders(spark, d, F.concat(F.lit("<table><tr><th>First"), row, F.lit("</table>"))), "o_orderkey", "html", pages.fighters_index, pages.FIGHTERS)


@query("SELECT page_id, length(trim(regexp_extract(html, '<title>(.*?)</title>', 1))) > 0 titled, len(regexp_extract_all(html, '<li>')) items FROM pages")
def page_outline(spark, d):
    """Real pages: that their titles are found, and their list items counted."""
    def outline(root):
        title = root.first("title")
        yield bool(title is not None and title.text()), sum(1 for _ in root.all("li"))

    got = pages.extract(table(spark, d, "pages"), "page_id", "html", outline, "titled boolean, items int")
    return got.withColumn("items", F.col("items").cast("bigint"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN 'A ' || o_custkey END red, CASE WHEN o_orderkey % 5 < 4 THEN 155.5::DOUBLE END red_lbs, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 2 = 0 END red_missed, CASE WHEN o_orderkey % 5 < 4 THEN 'B' END AS blue, CASE WHEN o_orderkey % 5 < 4 THEN CAST(150 + o_orderkey % 9 AS DOUBLE) END blue_lbs, CASE WHEN o_orderkey % 5 < 4 THEN o_orderkey % 3 = 0 END blue_missed, o_orderkey % 5 < 4 AS read FROM orders""")
def weigh_in_lines(spark, d):
    red, blue = F.when(order_key() % 2 == 0, "(155.5*)").otherwise("(155.5)"), F.when(order_key() % 3 == 0, say("(%d)**", 150 + order_key() % 9)).otherwise(say("(%d)", 150 + order_key() % 9))
    line = F.concat(F.when(order_key() % 5 < 4, "Main Event - Catchweight Bout (160-lbs): ").otherwise("Main contest; "), F.lit("A "), customer_key().cast("string"), F.lit(" "), red, F.lit(" vs. B "), blue)
    docs = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Intro A vs B\n"), line, F.lit("\nend")).alias("text"))
    return feeds.weigh_ins(docs, "o_orderkey", "text")


RSS = """<rss xmlns:media="urn:m"><channel><title>no</title><item><title><![CDATA[T & <%d>]]> &#8217;x&amp;</title><media:thumbnail url="u"/><link>http://x/%d</link><description>&lt;p&gt;Some  <![CDATA[text]]>&lt;/p&gt;</description>
<pubDate>lun, 12 ene 2026 08:30:00 +0000</pubDate></item><item><title>No link</title></item><item><title>Second</title><link>http://y/%d</link></item></channel></rss>"""


def feed_documents(spark, d):
    """One feed an order; one of seven breaks off."""
    whole = say(RSS, customer_key(), order_key(), order_key())
    return table(spark, d, "orders").select("o_orderkey", (order_key() % 5).alias("source"), F.when(order_key() % 7 == 0, F.substring(whole, 1, 150)).otherwise(whole).alias("xml"))


@query("""SELECT o_orderkey, 'T & <' || o_custkey || '> ’x&' title, 'http://x/' || o_orderkey link, 'Some text' summary, '2026-01-12 08:30:00' published FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, 'Second', 'http://y/' || o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 7 <> 0""")
def feed_rows(spark, d):
    return feeds.feed_items(feed_documents(spark, d), "o_orderkey", "xml").withColumn("published", F.col("published_at").cast("string")).drop("published_at")


@query("SELECT o_orderkey % 5 source, count(*) n FROM orders WHERE o_orderkey % 7 = 0 GROUP BY ALL")
def broken_feeds(spark, d):
    return feeds.broken_feeds(feed_documents(spark, d), "source", "xml")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 2 ELSE 0 END::BIGINT n, o_orderkey % 3 = 0 dead FROM orders")
def feed_health(spark, d):
    docs = table(spark, d, "orders").select("o_orderkey", F.when(order_key() % 3 > 0, say(RSS, customer_key(), order_key(), order_key())).otherwise("<rss/>").alias("xml"))
    return feeds.feed_counts(feeds.feed_items(docs, "o_orderkey", "xml"), docs, "o_orderkey")


@query("""WITH t AS (SELECT o_orderkey k, o_custkey c, o_orderkey % 7 w FROM orders) SELECT k o_orderkey, CASE w WHEN 0 THEN 'bad' ELSE 'l:' || CASE w WHEN 1 THEN '3321' ELSE '99' END || '~e:' || c || '~c:' || k END uid,
  CASE w WHEN 0 THEN 'bad_uid' WHEN 1 THEN 'main_league' WHEN 2 THEN 'main_named' WHEN 3 THEN 'no_result' END skipped, CASE WHEN w > 0 THEN CAST(k AS VARCHAR) END bout_id, CASE w WHEN 2 THEN 'TUF' ELSE 'Cage Night' END promotion, CASE w WHEN 3 THEN NULL WHEN 4 THEN 'nc' WHEN 5 THEN 'loss' ELSE 'win' END result,
  CASE w WHEN 4 THEN 'CNC' ELSE 'SUB' END AS method, CASE WHEN c % 4 > 0 THEN CAST(c % 4 AS INT) END end_round, CASE WHEN k % 2 = 0 THEN '4:05' END end_time, 'Opp ' || c opponent, c % 3 = 0 is_title FROM t
  UNION ALL SELECT k, 'lost', 'missing_entry', NULL, 'Regional', NULL, NULL, NULL, NULL, NULL, false FROM t""")
def career_documents(spark, d):
    w = order_key() % 7
    uid = F.when(w == 0, "bad").otherwise(F.concat(F.lit("l:"), F.when(w == 1, "3321").otherwise("99"), F.lit("~e:"), customer_key().cast("string"), F.lit("~c:"), order_key().cast("string")))
    entry = F.struct(
        F.when(w == 2, "TUF 33: Finale").otherwise("Cage Night 12: A vs B").alias("name"), F.lit("2020-01-01T00:00Z").alias("gameDate"), F.when(w == 3, "").when(w == 5, "L").otherwise("W").alias("gameResult"), (customer_key() % 3 == 0).alias("titleFight"), F.struct(F.lit("1").alias("id"), F.concat(F.lit("Opp "), customer_key().cast("string")).alias("displayName")).alias("opponent"),
        F.struct((customer_key() % 4).cast("int").alias("period"), F.when(order_key() % 2 == 0, "4:05").otherwise("-").alias("displayClock"), F.struct(F.when(w == 4, "no-contest").otherwise("submission").alias("name"), F.lit("x").alias("displayName")).alias("result")).alias("status"),
    )
    doc = F.to_json(F.struct(F.array(uid, F.lit("lost")).alias("events"), F.create_map(uid, entry).alias("eventsMap")))
    docs = table(spark, d, "orders").select("o_orderkey", doc.alias("doc"))
    return feeds.career(docs, "doc", "3321", {"3323": "Bellator"})


@query("SELECT o_orderkey, unnest(['A', 'B']) AS name, unnest([(1.5 + 2.5 + o_orderkey % 4) / 3, 2.0 + o_custkey % 3]) price, unnest([3, 1]) n FROM orders")
def odds_documents(spark, d):
    outcome = lambda name, price: F.struct(F.lit(name).alias("name"), price.cast("double").alias("price"))
    market = lambda key, *o: F.struct(F.lit(key).alias("key"), F.array(*o).alias("outcomes"))
    books = F.array(
        F.struct(F.lit("x").alias("key"), F.array(market("h2h", outcome("A", F.lit(1.5)), outcome("B", 2 + customer_key() % 3)), market("totals", outcome("A", F.lit(99.0)))).alias("markets")),
        F.struct(F.lit("y").alias("key"), F.array(market("h2h", outcome("A", F.lit(2.5)), outcome("", F.lit(7.0))), market("h2h", outcome("A", (order_key() % 4)))).alias("markets")),
    )
    docs = table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(books.alias("bookmakers"))).alias("doc"))
    got = feeds.odds(docs, "o_orderkey", "doc")
    return got.withColumn("n", F.col("n").cast("int"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN '2026-08-15 0' || o_orderkey % 10 || ':00:00' END taken, CASE o_orderkey % 3 WHEN 0 THEN 'scoreboard' WHEN 1 THEN 'stats' END kind, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_orderkey AS VARCHAR) END bout_id, CASE WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) END athlete_id FROM orders")
def capture_names(spark, d):
    ts = say("20260815T0%d0000Z-", order_key() % 10)
    name = F.when(order_key() % 3 == 0, F.concat(F.lit("/a/b/"), ts, F.lit("scoreboard.json"))).when(order_key() % 3 == 1, F.concat(ts, say("comp-%d-stats-%d.json", order_key(), customer_key()))).otherwise(F.concat(ts, F.lit("other.json")))
    c = feeds.capture_name(name)
    return table(spark, d, "orders").select("o_orderkey", c["taken"].cast("string").alias("taken"), *[c[x].alias(x) for x in ("kind", "bout_id", "athlete_id")])


@query("""SELECT 'node/' || o_orderkey osm_id, 'Gym ' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 41.5 ELSE 40.5 END::DOUBLE lat, 2.0::DOUBLE lon, 'boxing' AS sports, 'Street, ' || o_custkey AS address, 'https://gym.example' AS website, '93' AS phone FROM orders WHERE o_orderkey % 5 > 2""")
def map_places(spark, d):
    w = order_key() % 5
    tags = F.map_concat(F.create_map(F.lit("sport"), F.when(w == 0, "yoga").otherwise("Boxing;fitness"), F.lit("addr:street"), F.lit("Street"), F.lit("addr:housenumber"), customer_key().cast("string"), F.lit("contact:website"), F.lit("gym.example;b"), F.lit("phone"), F.lit("93;94")), F.create_map(F.lit("name"), F.when(w == 1, "Basic-Fit Boxing").when(w == 2, "").otherwise(F.concat(F.lit("Gym "), order_key().cast("string")))))
    point = lambda lat: F.struct(F.lit(lat).alias("lat"), F.lit(2.0).alias("lon"))
    e = F.struct(F.lit("node").alias("type"), order_key().alias("id"), F.when(order_key() % 2 == 0, 41.5).alias("lat"), F.when(order_key() % 2 == 0, 2.0).alias("lon"), point(40.5).alias("center"), tags.alias("tags"))
    docs = table(spark, d, "orders").select(F.to_json(F.struct(F.array(e, e).alias("elements"))).alias("doc"))
    return feeds.places(docs, "doc").withColumn("sports", F.array_join("sports", "|"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 3, 5, 7, 1000)")
def rows_by_id(spark, d):
    return feeds.lookup(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [1, 3, 5, 7, 1000])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1200 AND o_orderkey % 2 = 0")
def rows_by_many_ids(spark, d):
    return feeds.lookup(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", list(range(0, 1200, 2)), most=100)
