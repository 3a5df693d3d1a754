"""Game context, verdicts, readings, markets and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrace import landed
from terrace import workload as w
from terrace.functions.numbers import score_goals
from terrace.operators import consistency, market, narrative, priors, stats
from terrace.operators.minutes import latest
from terrace.registry.base import THRESHOLD, VIEWS, classified, exact4, place_number, q6, query, rounded, s6
from terrace.registry.reaction_queries import side_moods
from terrace.schemas import EMOTION_COLUMNS
from terrace.sources import detail

_SORTED = f"list_sort([{', '.join(EMOTION_COLUMNS)}], 'DESC')"

VIEWS.update({
    "keepers": """SELECT fixture_id, team, team_order, name AS keeper, saves, faced AS shots_faced, conceded FROM players
        WHERE position = 'G' QUALIFY row_number() OVER (PARTITION BY fixture_id, team ORDER BY saves DESC, roster_order) = 1""",
    "busiest": "SELECT * FROM keepers QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY saves DESC, team_order) = 1",
    "ctx": """SELECT f.fixture_id, f.side, f.team, CASE WHEN own > other THEN 'leading' WHEN own < other THEN 'trailing' ELSE 'level' END AS status,
        abs(own - other) AS margin, coalesce(l.delta_xg_10min, 0) AS threat, coalesce(k.saves, 0) AS keeper_saves FROM (
          SELECT fixture_id, 'home' AS side, home_team AS team, CAST(split_part(score, '-', 1) AS INTEGER) AS own, CAST(split_part(score, '-', 2) AS INTEGER) AS other FROM fx
          UNION ALL SELECT fixture_id, 'away', away_team, CAST(split_part(score, '-', 2) AS INTEGER), CAST(split_part(score, '-', 1) AS INTEGER) FROM fx) f
        LEFT JOIN latest l ON l.fixture_id = f.fixture_id LEFT JOIN keepers k ON k.fixture_id = f.fixture_id AND k.team = f.team""",
    "clear0": f"""SELECT *, least(1e0, 0.5e0 * ({_SORTED}[1] - {_SORTED}[2]) + 0.3e0 * coverage + 0.2e0 * least(1e0, volume / 30e0)) AS c
        FROM side_mood""",
    "clear": f"SELECT * EXCLUDE (c), {exact4('c')} AS clarity FROM clear0",
    "verd": """SELECT fixture_id, side, m.team, clarity, dominant, status,
        CASE WHEN status = 'trailing' AND dominant IN ('joy', 'confidence') THEN 'conflict'
          WHEN status = 'leading' AND dominant IN ('panic', 'despair', 'anger') AND keeper_saves <= 2 THEN 'conflict' ELSE 'consistent' END AS verdict,
        CASE WHEN status = 'trailing' AND dominant IN ('joy', 'confidence') THEN m.team || ' trail by ' || margin || ' yet fan mood reads ' || dominant
            || ' - conflicting with the game situation. Either a genuine anomaly (e.g. a consolation goal or pride in the performance) or a misread window; treat as a possible overreaction moment.'
          WHEN status = 'leading' AND dominant IN ('panic', 'despair', 'anger') AND keeper_saves <= 2 THEN m.team || ' lead by ' || margin
            || ' and their goal is not under siege (keeper saves: ' || printf('%.0f', keeper_saves) || '), yet fan mood reads ' || dominant
            || ' - nervousness ahead of the game situation; classic overreaction territory.'
          WHEN status = 'leading' AND dominant IN ('panic', 'despair', 'anger') THEN m.team || ' lead but the keeper is busy ('
            || printf('%.0f', keeper_saves) || ' saves), so a ' || dominant || ' crowd is understandable - the lead is under pressure.'
          ELSE m.team || ' fans read as ' || dominant || ', which fits a side that is ' || status || '.' END AS explanation
        FROM clear m JOIN ctx USING (fixture_id, side)""",
    "notes": """SELECT fixture_id, ' Pitch data - ' || string_agg(team || ': ' || p || '% possession, ' || t || ' on target', '; ' ORDER BY team_order) || '.' AS note
        FROM (SELECT fixture_id, team_order, team, max(CASE WHEN stat = 'possessionPct' THEN value END) AS p,
              max(CASE WHEN stat = 'shotsOnTarget' THEN value END) AS t FROM tstats GROUP BY ALL) GROUP BY 1""",
    "named": """SELECT l.*, note, keeper, saves, shots_faced FROM latest l LEFT JOIN notes USING (fixture_id)
        LEFT JOIN (SELECT fixture_id, keeper, saves, shots_faced FROM busiest) USING (fixture_id)""",
    "rules": f"""SELECT fixture_id, list_filter([
        CASE WHEN arbitrage_index >= {THRESHOLD} AND crowd_panic_score > 0 THEN {{'tone': 'warning', 'headline': 'Market overreaction signal',
          'detail': 'Crowd mood is dominated by ' || dominant_emotion || ' while the underlying threat level is stable (xG stability '
          || printf('%.2f', delta_xg_10min) || '). Historically the spot where sentiment-driven prices decouple from the pitch.' || coalesce(note, '')}} END,
        CASE WHEN crowd_panic_score <= -0.4 AND delta_xg_10min < 0.3 THEN {{'tone': 'warning', 'headline': 'Complacency risk',
          'detail': 'The crowd is euphoric/confident but the match data shows little attacking control (xG stability '
          || printf('%.2f', delta_xg_10min) || '). Sentiment may be lagging a genuine momentum shift.' || coalesce(note, '')}} END,
        CASE WHEN emo_anger >= 0.35 THEN {{'tone': 'info', 'headline': 'Anger-driven sentiment',
          'detail': 'A large share of reactions are about officiating or frustration, not match state. Treat the panic score as noisy until this clears.'}} END,
        CASE WHEN emotional_volatility >= 0.5 THEN {{'tone': 'info', 'headline': 'Unstable crowd mood', 'detail': 'Emotional volatility is high ('
          || printf('%.2f', emotional_volatility) || '); the crowd is reacting to every event. Wait for the mood to settle before trusting the signal.'}} END,
        CASE WHEN keeper IS NOT NULL AND crowd_panic_score > 0.3 AND saves >= 3 THEN {{'tone': 'info', 'headline': 'Keeper holding the line',
          'detail': 'Fans are anxious, but ' || keeper || ' has made ' || printf('%.0f', saves) || ' saves'
          || CASE WHEN shots_faced > 0 THEN ' from ' || printf('%.0f', shots_faced) || ' shots faced' ELSE '' END
          || ' - the pressure is real but it is being handled.'}} END], lambda r: r IS NOT NULL) AS fired,
        {{'tone': 'positive', 'headline': 'Sentiment aligned with match state', 'detail': 'Dominant emotion (' || dominant_emotion
          || ') is consistent with the pitch data (panic ' || printf('%+.2f', crowd_panic_score) || ', xG stability '
          || printf('%.2f', delta_xg_10min) || '). No divergence to exploit right now.' || coalesce(note, '')}} AS aligned FROM named""",
    "consensus": "SELECT event_id, outcome, avg(price) AS price, min(pos) AS first_pos FROM prices GROUP BY ALL",
    "probs": """SELECT *, round_even((1 / price) / sum(1 / price) OVER (PARTITION BY event_id), 4) AS probability FROM consensus""",
    "mkt": """SELECT event_id, max(CASE WHEN outcome = 'A' THEN probability END) AS home_prob,
        max(CASE WHEN outcome = 'Draw' THEN probability END) AS draw_prob, max(CASE WHEN outcome = 'R' THEN probability END) AS away_prob,
        first(outcome ORDER BY probability DESC, first_pos) AS favorite, round_even(max(probability), 4) AS certainty
        FROM probs GROUP BY 1""",
    "mev_names": f"""SELECT p_partkey AS event_id, 'fc ' || lower(({w.TEAMS})[(p_partkey + p_partkey // 7) % 8 + 1]) || ' '
        || lower(({w.TEAMS})[(p_partkey * 3 + p_partkey // 7) % 8 + 1]) || ' united' AS blob FROM part""",
    "fx_event": """SELECT fixture_id, min(event_id) AS event_id FROM fx JOIN mev_names
        ON contains(blob, lower(home_team)) AND contains(blob, lower(away_team)) GROUP BY 1""",
    "sched": """SELECT h.n_name AS home_team, a.n_name AS away_team, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'abandoned'
        ELSE CAST(o_orderkey % 5 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '–' END || CAST(o_orderkey % 3 AS VARCHAR) END AS score,
        o_orderkey % 5 AS hg, o_orderkey % 3 AS ag
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation h ON h.n_nationkey = c_nationkey
        JOIN nation a ON a.n_nationkey = (c_nationkey + 1 + o_orderkey % 24) % 25""",
    "pri": """SELECT team, count(*) AS matches_played, avg(gf) AS goals_for_per_match, avg(ga) AS goals_against_per_match FROM (
        SELECT home_team AS team, hg AS gf, ag AS ga FROM sched WHERE score IS NOT NULL AND score <> 'abandoned'
        UNION ALL SELECT away_team, ag, hg FROM sched WHERE score IS NOT NULL AND score <> 'abandoned') GROUP BY 1""",
    "pairs": "SELECT n_nationkey, n_name AS home_team, CASE WHEN n_nationkey % 5 = 0 THEN 'Nowhere' ELSE 'nation_' || CAST((n_nationkey * 7 + 3) % 25 AS VARCHAR) || ' ' END AS away_team FROM nation",
})


def _latest(spark, sf):
    return latest(classified(spark, sf))


def _stats(spark, sf):
    return detail.team_stats(landed.box_scores(spark, sf))


def _keepers(spark, sf):
    return stats.keeper_load(detail.player_stats(landed.rosters(spark, sf)))


def _context(spark, sf):
    return consistency.game_context(w.fixtures(spark, sf), _latest(spark, sf), _keepers(spark, sf))


def _verdicts(spark, sf):
    return consistency.mood_verdicts(side_moods(spark, sf), _context(spark, sf))


@query("parsed_scores", """SELECT home_team, away_team, CAST(hg AS INTEGER) AS home_goals, CAST(ag AS INTEGER) AS away_goals, count(*) AS n
    FROM sched WHERE score IS NOT NULL AND score <> 'abandoned' GROUP BY ALL""")
def parsed_scores(spark, sf):
    goals = schedule(spark, sf).withColumn("g", score_goals(F.col("score"))).filter(F.col("g").isNotNull())
    return goals.groupBy("home_team", "away_team", F.col("g.home").alias("home_goals"), F.col("g.away").alias("away_goals")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("game_context", f"SELECT fixture_id, side, team, status, margin, {q6('threat')}, keeper_saves FROM ctx")
def game_context(spark, sf):
    return rounded(_context(spark, sf), "threat")


@query("clarity", f"SELECT fixture_id, side, {q6('clarity')} FROM clear")
def clarity(spark, sf):
    return rounded(consistency.with_clarity(side_moods(spark, sf)), "clarity").select("fixture_id", "side", "clarity")


@query("mood_verdicts", "SELECT fixture_id, side, team, verdict, explanation, clarity, dominant, status FROM verd")
def mood_verdicts(spark, sf):
    return _verdicts(spark, sf)


@query("conflict_moments", """SELECT fixture_id, side, CASE WHEN status = 'trailing' THEN 'positive-while-losing' ELSE 'panic-while-ahead' END AS reason,
    team, explanation AS detail FROM verd WHERE verdict = 'conflict'""")
def conflict_moments(spark, sf):
    return consistency.conflict_moments(_verdicts(spark, sf))


_SHARE = """CASE WHEN max({0}) FILTER (team_order = 0) + max({0}) FILTER (team_order = 1) <> 0 THEN
    max({0}) FILTER (team_order = 0) / (max({0}) FILTER (team_order = 0) + max({0}) FILTER (team_order = 1)) END"""


@query("control_index", f"""SELECT fixture_id, {s6('a')} AS "possessionPct", {s6('b')} AS "shotsOnTarget", {s6('c')} AS "totalShots",
    {s6('(coalesce(0.45 * a, 0) + coalesce(0.35 * b, 0) + coalesce(0.2 * c, 0)) / ((CASE WHEN a IS NULL THEN 0 ELSE 0.45 END) + (CASE WHEN b IS NULL THEN 0 ELSE 0.35 END) + (CASE WHEN c IS NULL THEN 0 ELSE 0.2 END))')} AS control_index
    FROM (SELECT fixture_id, {_SHARE.format('p')} AS a, {_SHARE.format('t')} AS b, {_SHARE.format('s')} AS c FROM (
      SELECT fixture_id, team_order, CASE WHEN stat = 'possessionPct' THEN CAST(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE) END AS p,
        CASE WHEN stat = 'shotsOnTarget' THEN CAST(value AS DOUBLE) END AS t, CASE WHEN stat = 'totalShots' THEN CAST(value AS DOUBLE) END AS s
        FROM tstats) GROUP BY 1)""".replace("CAST(value AS DOUBLE)", "CAST(regexp_replace(value, '[^0-9.]', '', 'g') AS DOUBLE)"))
def control_index(spark, sf):
    return rounded(stats.control_index(_stats(spark, sf)), "possessionPct", "shotsOnTarget", "totalShots", "control_index")


@query("stat_matrix", """SELECT fixture_id, stat, max(CASE WHEN team_order = 0 THEN value END) AS home_value,
    max(CASE WHEN team_order = 1 THEN value END) AS away_value FROM tstats GROUP BY ALL""")
def stat_matrix(spark, sf):
    return stats.stat_matrix(_stats(spark, sf))


@query("keeper_load", "SELECT fixture_id, team, keeper, saves, shots_faced, conceded FROM keepers")
def keeper_load(spark, sf):
    return _keepers(spark, sf).drop("team_order")


@query("top_performers", """SELECT fixture_id, team, concat_ws('; ', max(CASE WHEN category = 'totalShots' THEN leader || ' shots' END),
    max(CASE WHEN category = 'accuratePasses' THEN leader || ' passes' END), max(CASE WHEN category = 'saves' THEN leader || ' saves' END)) AS line
    FROM tops GROUP BY ALL""")
def top_performers(spark, sf):
    return stats.top_performers(detail.leaders(landed.leaders(spark, sf)))


@query("goal_lines", """SELECT fixture_id, event_order * 1000000 AS event_order, CAST(minute AS VARCHAR) || ''' ' || team || ' — '
    || CASE WHEN text = '' THEN type ELSE text END AS line FROM kev WHERE type IN ('goal', 'penalty--scored', 'own-goal')""")
def goal_lines(spark, sf):
    goals = stats.goal_lines(detail.key_events(landed.key_events(spark, sf)))
    return goals.withColumn("event_order", place_number("event_order"))


@query("takeaways", """SELECT fixture_id, CAST(position - 1 AS INTEGER) AS position, r.tone, r.headline, r.detail FROM (
    SELECT fixture_id, unnest(CASE WHEN len(fired) > 0 THEN fired ELSE [aligned] END) AS r,
    unnest(range(1, 1 + greatest(len(fired), 1))) AS position FROM rules)""")
def takeaways(spark, sf):
    keepers = stats.busiest_keeper(_keepers(spark, sf))
    return narrative.takeaways(_latest(spark, sf), THRESHOLD, narrative.pitch_notes(_stats(spark, sf)), keepers)


@query("headlines", f"""SELECT fixture_id, 'Right now: fans are ' || CASE WHEN crowd_panic_score > 0.25 THEN 'anxious' WHEN crowd_panic_score < -0.25
    THEN 'calm and confident' ELSE 'split' END || ' while ' || CASE WHEN delta_xg_10min >= 0.45 THEN 'the match is producing real chances'
    WHEN delta_xg_10min <= 0.2 THEN 'the match itself is fairly quiet' ELSE 'the match is evenly balanced' END || ' — ' ||
    CASE WHEN arbitrage_index >= {THRESHOLD} AND crowd_panic_score > 0 THEN 'fans are spiking faster than the pitch justifies — a possible overreaction.'
    WHEN crowd_panic_score <= -0.4 AND delta_xg_10min < 0.3 THEN 'fans look relaxed even though the game is flat — watch for a momentum swing.'
    ELSE 'fan mood and the match are roughly in step.' END || coalesce(who, '') AS headline FROM latest LEFT JOIN (
      SELECT fixture_id, ' ' || string_agg(team || ' fans: ' || dominant, ' | ' ORDER BY side DESC) || '.' AS who
      FROM side_mood WHERE volume > 0 GROUP BY 1) USING (fixture_id)""")
def headlines(spark, sf):
    return narrative.headlines(_latest(spark, sf), THRESHOLD, side_moods(spark, sf))


@query("overreaction_trigger", """SELECT fixture_id, flagged OR fixture_id IN (SELECT fixture_id FROM verd WHERE verdict = 'conflict') AS overreacting FROM latest""")
def overreaction_trigger(spark, sf):
    return narrative.overreaction_trigger(_latest(spark, sf), consistency.conflict_moments(_verdicts(spark, sf)))


_EVIDENCE = """list_filter([CASE WHEN shots NOT IN ('', '0', '0.0') THEN shots || ' shots on target' END,
    CASE WHEN delta_xg_10min >= 0.3 THEN 'live attacking threat ' || printf('%.2f', delta_xg_10min) END,
    CASE WHEN k.saves >= 3 THEN opponent || '''s keeper has needed ' || printf('%.0f', k.saves) || ' saves to keep this scoreline' END],
    lambda e: e IS NOT NULL)"""


@query("underdog_evidence", f"""SELECT * FROM (SELECT u.fixture_id, underdog, opponent, score, coalesce(minute, 0) AS minute,
    array_to_string({_EVIDENCE}, '; ') AS evidence FROM (
      SELECT fixture_id, score, CASE WHEN home_is THEN home_team ELSE away_team END AS underdog, CASE WHEN home_is THEN away_team ELSE home_team END AS opponent
      FROM (SELECT fx.*, CASE WHEN split_part(score, '-', 1)::INT < split_part(score, '-', 2)::INT THEN true
        WHEN split_part(score, '-', 2)::INT < split_part(score, '-', 1)::INT THEN false WHEN home_prob > 0 AND away_prob > 0 THEN home_prob < away_prob END AS home_is
        FROM fx LEFT JOIN fx_event USING (fixture_id) LEFT JOIN mkt USING (event_id)) WHERE home_is IS NOT NULL) u
    LEFT JOIN (SELECT fixture_id, team, value AS shots FROM tstats WHERE stat = 'shotsOnTarget') s ON s.fixture_id = u.fixture_id AND s.team = underdog
    LEFT JOIN keepers k ON k.fixture_id = u.fixture_id AND k.team = opponent LEFT JOIN latest l ON l.fixture_id = u.fixture_id)
    WHERE evidence <> ''""")
def underdog_evidence(spark, sf):
    return narrative.underdog_evidence(
        w.fixtures(spark, sf), _latest(spark, sf), _stats(spark, sf), _keepers(spark, sf), fixture_markets(spark, sf)
    )


def fixture_markets(spark, sf):
    return _fixture_events(spark, sf).join(_market(spark, sf), "event_id")


def _odds(spark, sf):
    return detail.odds(landed.odds(spark, sf))


def _events(spark, sf):
    """Every part is an event between A and R, as its order lines say."""
    return w.table(spark, sf, "part").select(
        F.col("p_partkey").alias("event_id"), F.lit("A").alias("home_team"), F.lit("R").alias("away_team")
    )


def _market(spark, sf):
    probabilities = market.implied_probabilities(market.consensus_prices(_odds(spark, sf)))
    return market.market_rows(probabilities, _events(spark, sf))


def _fixture_events(spark, sf):
    return market.match_events(w.fixtures(spark, sf), detail.odds_events(landed.market_events(spark, sf)))


@query("consensus_prices", f"SELECT event_id, outcome, {q6('price')} FROM consensus")
def consensus_prices(spark, sf):
    return rounded(market.consensus_prices(_odds(spark, sf)), "price").drop("outcome_order")


@query("implied_probabilities", "SELECT event_id, outcome, probability FROM probs")
def implied_probabilities(spark, sf):
    prices = market.consensus_prices(_odds(spark, sf))
    return market.implied_probabilities(prices).select("event_id", "outcome", "probability")


@query("market_rows", "SELECT event_id, home_prob, draw_prob, away_prob, favorite, certainty FROM mkt")
def market_rows(spark, sf):
    return _market(spark, sf)


@query("fixture_events", "SELECT fixture_id, event_id FROM fx_event")
def fixture_events(spark, sf):
    return _fixture_events(spark, sf)


@query("market_divergence", "SELECT fixture_id, round_even(round(abs(crowd_panic_score) * certainty, 12), 4) AS divergence FROM latest JOIN fx_event USING (fixture_id) JOIN mkt USING (event_id)")
def market_divergence(spark, sf):
    quoted = _fixture_events(spark, sf).join(_market(spark, sf), "event_id")
    gap = market.divergence(F.col("crowd_panic_score"), F.col("certainty"))
    return _latest(spark, sf).join(quoted, "fixture_id").select("fixture_id", gap.alias("divergence"))


def schedule(spark, sf):
    """Orders as matches: the customer's nation at home, another nation away."""
    nation = w.table(spark, sf, "nation")
    customers = w.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = w.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    dash = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "-").otherwise("–")
    goals = F.concat(F.pmod("o_orderkey", F.lit(5)).cast("string"), dash, F.pmod("o_orderkey", F.lit(3)).cast("string"))
    score = F.when(F.pmod("o_orderkey", F.lit(11)) == 0, "abandoned").otherwise(goals)
    away = F.pmod(F.col("c_nationkey") + 1 + F.pmod("o_orderkey", F.lit(24)), F.lit(25))
    return (
        rows.withColumns({
            "away_key": away, "score": F.when(F.pmod("o_orderkey", F.lit(7)) != 0, score),
        })
        .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("home_team")), "c_nationkey")
        .join(nation.select(F.col("n_nationkey").cast("bigint").alias("away_key"), F.col("n_name").alias("away_team")), "away_key")
        .select("home_team", "away_team", "score")
    )


@query("team_priors", f"SELECT team, matches_played, {q6('goals_for_per_match', 'goals_against_per_match')} FROM pri")
def team_priors(spark, sf):
    table = priors.team_priors(schedule(spark, sf))
    return rounded(table, "goals_for_per_match", "goals_against_per_match").select(
        "team", "matches_played", "goals_for_per_match", "goals_against_per_match"
    )


@query("priors_with_stats", f"""SELECT team, matches_played, {s6('CASE WHEN n_nationkey % 4 > 0 THEN x / (n_nationkey % 4) ELSE x END')} AS xg_for_per_match,
    {s6('n_regionkey * 10.5')} AS possession_pct FROM pri LEFT JOIN (SELECT *, n_nationkey * 1.5 AS x FROM nation WHERE n_nationkey % 3 <> 0) ON n_name = team""")
def priors_with_stats(spark, sf):
    season = w.table(spark, sf, "nation").filter(F.pmod("n_nationkey", F.lit(3)) != 0).select(
        F.col("n_name").alias("team"), F.pmod("n_nationkey", F.lit(4)).alias("played"),
        (F.col("n_nationkey") * 1.5).alias("xg"), (F.col("n_regionkey") * 10.5).alias("possession"),
    )
    table = priors.team_priors(schedule(spark, sf), season)
    return rounded(table, "xg_for_per_match", "possession_pct").select(
        "team", "matches_played", "xg_for_per_match", "possession_pct"
    )


@query("fixture_prior", """SELECT CAST(p.n_nationkey AS VARCHAR) AS fixture_id, h.matches_played AS home_played, a.matches_played AS away_played,
    round_even((h.goals_for_per_match - h.goals_against_per_match) - (a.goals_for_per_match - a.goals_against_per_match), 2) AS edge
    FROM pairs p LEFT JOIN pri h ON lower(h.team) = lower(trim(p.home_team)) LEFT JOIN pri a ON lower(a.team) = lower(trim(p.away_team))
    WHERE h.team IS NOT NULL OR a.team IS NOT NULL""")
def fixture_prior(spark, sf):
    key = F.col("n_nationkey")
    other = F.concat(F.lit("nation_"), F.pmod(key * 7 + 3, F.lit(25)).cast("string"), F.lit(" "))
    pairs = w.table(spark, sf, "nation").select(
        key.cast("string").alias("fixture_id"), F.col("n_name").alias("home_team"),
        F.when(F.pmod(key, F.lit(5)) == 0, "Nowhere").otherwise(other).alias("away_team"),
    )
    return priors.fixture_prior(pairs, priors.team_priors(schedule(spark, sf))).select(
        "fixture_id", "home_played", "away_played", "edge"
    )
