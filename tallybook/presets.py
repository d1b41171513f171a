"""Ready-made spec of the 34-column music catalog extract.

The values below are fixed: they are the published layout and rules of that
extract, stated here so its files can be read and checked.
"""

from tallybook.sources.csv import CsvLayout
from tallybook.spec import CatalogSpec, ModelSpec

# Header names in file order with their types.
MUSIC_COLUMNS = (
    ("track", "string"),
    ("artist_1", "string"),
    ("artist_1_pop", "double"),
    ("artist_2", "string"),
    ("artist_2_pop", "double"),
    ("artist_3", "string"),
    ("artist_3_pop", "double"),
    ("artist_1_genre_1", "string"),
    ("artist_1_genre_2", "string"),
    ("artist_1_genre_3", "string"),
    ("artist_2_genre_1", "string"),
    ("artist_2_genre_2", "string"),
    ("artist_2_genre_3", "string"),
    ("artist_3_genre_1", "string"),
    ("artist_3_genre_2", "string"),
    ("artist_3_genre_3", "string"),
    ("release_date", "int"),
    ("release_decade", "int"),
    ("danceability", "string"),
    ("energy", "string"),
    ("speechiness", "string"),
    ("acousticness", "string"),
    ("instrumentalness", "string"),
    ("liveness", "string"),
    ("popularity", "string"),
    ("duration", "string"),
    ("album_type", "string"),
    ("popularity_score", "int"),
    ("key", "string"),
    ("loudness", "double"),
    ("valence", "double"),
    ("tempo", "double"),
    ("duration_ms", "bigint"),
    ("time_signature", "int"),
)

# Columns that must exist whatever else changed.
MUSIC_REQUIRED = (
    "track",
    "artist_1",
    "artist_1_pop",
    "artist_1_genre_1",
    "release_date",
    "popularity",
    "popularity_score",
    "album_type",
    "tempo",
    "duration_ms",
    "time_signature",
)

# Digest and row count of the published file.
MUSIC_SHA256 = "4045adda473d6cd4fde6f3a11253faf37d7ee26fd122bcfd5c8a6c1fc5441974"
MUSIC_ROWS = 277_938

MUSIC_LAYOUT = CsvLayout(
    columns=MUSIC_COLUMNS,
    required=MUSIC_REQUIRED,
    expected_rows=MUSIC_ROWS,
)

MUSIC = CatalogSpec(
    item="track",
    creator="artist_1",
    creator_score="artist_1_pop",
    score="popularity_score",
    category="artist_1_genre_1",
    segment="album_type",
    year="release_date",
    period_fallback="release_decade",
    size="duration_ms",
    measure="tempo",
    band="popularity",
    domain_column="time_signature",
    domain_values=(3, 4, 5, 7),
    zero_label="zero_tempo",
    # Credits that do not name one performer.
    placeholder_creators=("Various Artists", "Original Cast", "Unknown", "Unknown Artist"),
    # The patterns that the labels above were searched with.
    placeholder_patterns=("^various artists?$", "^unknown( artist)?$", "^n/?a$", "^original cast$"),
    year_value="release_year",
    period="release_decade_clean",
    size_scaled="track_duration_minutes",
    tier="popularity_tier",
    is_high="is_high_popularity",
    has_category="has_primary_genre",
    exact_repeat="exact_duplicate_flag",
    key_repeat="track_artist_duplicate_flag",
    measure_quality="tempo_quality_flag",
    is_sentinel_year="suspicious_release_date_flag",
)

# Features, reference levels, seeds and published table names.
MUSIC_MODEL_A = ModelSpec(
    "model_a",
    ("loudness", "valence", "tempo", "track_duration_minutes"),
    {"album_type": "album", "artist_1_genre_1": "Unknown", "release_decade_clean": "2010"},
)
MUSIC_MODEL_B = MUSIC_MODEL_A.plus("model_b", "artist_1_pop")
MUSIC_TABLES = {"primary": "tracks_primary", "sensitivity": "tracks_sensitivity"}

# Columns of the cardinality and range audits.
MUSIC_CATEGORICAL_AUDIT = (
    "danceability",
    "energy",
    "speechiness",
    "acousticness",
    "instrumentalness",
    "liveness",
    "popularity",
    "duration",
    "album_type",
    "time_signature",
    "key",
    "artist_1_genre_1",
)
MUSIC_NUMERIC_AUDIT = (
    "artist_1_pop",
    "release_date",
    "popularity_score",
    "loudness",
    "valence",
    "tempo",
    "duration_ms",
)
MUSIC_PAIRS = {"artist_2": "artist_2_pop", "artist_3": "artist_3_pop"}
