"""Declared schemas of the known data sets. Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql.types import StructType

# Field names and types of each data set, in file order.
_BATTING = (
    "G int, PA int, AB int, HBP int, SH int, BB int, H int, h1B int, h2B int, h3B int, HR int, "
    "R int, RBI int"
)

DDL = {
    "bat_seasons": (
        "player_id string, name_first string, name_last string, year_id int, team_id string, "
        f"lg_id string, age int, {_BATTING}"
    ),
    "people": (
        "player_id string, birth_year int, birth_month int, birth_day int, birth_city string, "
        "birth_state string, birth_country string, death_year int, death_month int, "
        "death_day int, death_city string, death_state string, death_country string, "
        "name_first string, name_last string, name_given string, height_in int, weight_lb int, "
        "bats string, throws string, beg_date string, end_date string, college string, "
        "retro_id string, bbref_id string"
    ),
    "park_team_years": (
        "park_id string, team_id string, year_id bigint, beg_date string, end_date string, "
        "n_games bigint"
    ),
    "games": (
        "game_id string, year_id int, away_team_id string, home_team_id string, "
        "away_runs_ct int, home_runs_ct int"
    ),
    "events": (
        "game_id string, event_seq int, year_id int, game_date string, game_seq int, "
        "away_team_id string, home_team_id string, inn int, inn_home int, beg_outs_ct int, "
        "away_score int, home_score int, event_desc string, event_cd int, hit_cd int, "
        "ev_outs_ct int, ev_runs_ct int, bat_dest int, run1_dest int, run2_dest int, "
        "run3_dest int, is_end_bat int, is_end_inn int, is_end_game int, bat_team_id string, "
        "fld_team_id string, pit_id string, bat_id string, run1_id string, run2_id string, "
        "run3_id string"
    ),
    "all_stars": (
        "player_id string, year_id int, game_seq int, game_id string, team_id string, "
        "lg_id string, GP int, starting_pos int"
    ),
    "hof_bat": (
        "player_id string, inducted_by string, is_inducted boolean, is_pending int, "
        "max_pct bigint, n_ballots bigint, hof_score bigint, year_eligible bigint, "
        "year_inducted bigint, pcts string"
    ),
    "parks": (
        "park_id string, park_name string, beg_date string, end_date string, is_active int, "
        "n_games bigint, lng double, lat double, city string, state_id string, country_id string"
    ),
    "geonames": (
        "geonameid string, name string, asciiname string, alternatenames string, "
        "latitude float, longitude float, feature_class string, feature_code string, "
        "country_code string, cc2 string, admin1_code string, admin2_code string, "
        "admin3_code string, admin4_code string, population int, elevation int, dem string, "
        "timezone string, modification_date string"
    ),
    "sightings": (
        "sighted_at string, reported_at string, location_str string, shape string, "
        "duration_str string, description string, lng float, lat float, city string, "
        "county string, state string, country string"
    ),
    "pageviews": "project_name string, page_title string, requests bigint, bytes bigint",
    "bat_careers": (
        "player_id string, n_seasons bigint, card_teams bigint, beg_year int, end_year int, "
        + _BATTING.replace(" int", " bigint")
        + ", OBP double, SLG double, OPS double"
    ),
    "career_epochs": (
        "player_id string, PA_all bigint, PA_young bigint, PA_prime bigint, PA_older bigint, "
        "beg_year int, end_year int, OPS_all float, OPS_young float, OPS_prime float, "
        "OPS_older float, n_seasons bigint, n_young bigint, n_prime bigint, n_older bigint"
    ),
    "team_park_seasons": "team_id string, park_years array<struct<year:int,park_id:string>>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])
