"""Parameters shared by the registered queries and their SQL counterparts."""

from __future__ import annotations

from datetime import datetime

from convoy.settings import Clock

START = datetime(2024, 1, 1)
FLEET_SIZE = 10

# Slices wide enough for the sparse test events to fill; blocks short enough to be crossed.
WIDTH_MINUTES = 720
MIN_RECORDS = 12
# Slices in a row for which a truck of the training data has one class.
STRETCH_SLICES = 3
ELEVATED = 0.87
BLOCK_SLICES = 8

# Slices a stream keeps open behind the newest reading.
OPEN_SLICES = 3

# State is built up to the cut, in the middle of a slice, and then brought up to date.
CUT = datetime(2024, 1, 20, 5, 17)

SERIES_EPOCH = 100
BACKFILL_EPOCHS = 200
STATUS_CLOCK = Clock(START, 500_000)
SERIES_CLOCK = Clock(START, SERIES_EPOCH)
MAP_EPOCH = 1_000_000
LOOKUP_EPOCH = 200_000
CHART_HOURS = 240
PROJECTION_HOURS = 6
KEEP_EVERY = 5
STREAM_DELAY_HOURS = 1
PATH_ROUNDS = 24
