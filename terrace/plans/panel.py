"""Tables behind the live panel of all fixtures: detail views, readings, conflicts, market."""

from __future__ import annotations

from pyspark.sql import DataFrame

from terrace.functions.lexicon import EMOTION_TERMS, Lexicon, emotion_intensities
from terrace.operators import attribution, consistency, market, mood, narrative, selector, situation, stats
from terrace.operators.minutes import latest
from terrace.sources import detail


def fixture_detail(landed: DataFrame) -> dict[str, DataFrame]:
    """Statistics, players, leaders, key events and what is derived from them."""
    team_stats = detail.team_stats(landed)
    players = detail.player_stats(landed)
    leaders = detail.leaders(landed)
    events = detail.key_events(landed)
    return {
        "stats": team_stats, "players": players, "leaders": leaders, "key_events": events,
        "control_index": stats.control_index(team_stats), "stat_matrix": stats.stat_matrix(team_stats),
        "keepers": stats.keeper_load(players), "performers": stats.top_performers(leaders),
        "goals": stats.goal_lines(events),
    }


def panel(
    state: DataFrame, tagged_chat: DataFrame, fixtures: DataFrame, parts: dict[str, DataFrame],
    threshold: float, fixture_markets: DataFrame, lexicon: Lexicon = EMOTION_TERMS,
) -> dict[str, DataFrame]:
    """Every table of the panel, lazy; ``fixture_markets`` is (fixture_id, market columns)."""
    now = latest(state)
    shared = mood.emotion_shares(emotion_intensities(tagged_chat, "message", lexicon))
    sides = attribution.side_mood(shared, fixtures)
    context = consistency.game_context(fixtures, now, parts["keepers"])
    verdicts = consistency.mood_verdicts(sides, context)
    conflicts = consistency.conflict_moments(verdicts)
    gap = market.divergence(now["crowd_panic_score"], fixture_markets["certainty"])
    return {
        "key_metrics": situation.key_metrics(state),
        "change": selector.minute_change(state),
        "flags": selector.flagged_by_index(state),
        "takeaways": narrative.takeaways(
            now, threshold, narrative.pitch_notes(parts["stats"]), stats.busiest_keeper(parts["keepers"])
        ),
        "headlines": narrative.headlines(now, threshold, sides),
        "side_mood": sides, "verdicts": verdicts, "conflicts": conflicts,
        "trigger": narrative.overreaction_trigger(now, conflicts),
        "divergence": now.join(fixture_markets, "fixture_id").select("fixture_id", gap.alias("divergence")),
        "underdogs": narrative.underdog_evidence(fixtures, now, parts["stats"], parts["keepers"], fixture_markets),
    }
