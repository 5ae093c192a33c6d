"""Every number that a rule compares with, in one place. The comparator that each rule uses is in the comment."""

MAX_AUDIO_SEC = 25.0  # duration >
MIN_AUDIO_SEC = 0.5  # duration <
CLIP_PEAK = 0.99  # peak >=
MAX_SILENCE_SEC = 2.0  # longest silent run >
SILENCE_AMPLITUDE = 0.005  # abs(sample) <=
CHAR_RATE_RATIO = 3.0  # rate > v * median or < median / v
CHAR_RATE_MIN_PAIRS = 10  # n >=

MIN_COVERAGE = 0.999  # coverage <
MAX_OOV = 0.001  # rate >
MAX_TOKENS_PER_SEC = 50.0  # rate >
MAX_SPLIT_SHARE = 0.01  # splits > v * lines

DIVERGE_RATIO = 1.5  # last > v * floor
FLAT_VARIATION = 0.001  # std / mean <
GRAD_SPIKE_RATIO = 10.0  # norm > v * median
GRAD_MIN_POINTS = 6  # n >=
LR_WARN_SHARE = 0.1  # share >
LR_FAIL_SHARE = 0.99  # share >=
MIN_IMPROVEMENT = 0.05  # end >= start * (1 - v)
IMPROVEMENT_WINDOW = 5
IMPROVEMENT_MIN_POINTS = 10  # n >=
DEGENERATE_MIN_POINTS = 5  # n >=
OVERFIT_RATIO = 1.2  # median of the last evals > v * least
OVERFIT_MIN_EVALS = 4  # n >=
OVERFIT_LAST = 3
STEP_CLIFF_RATIO = 3.0  # late > v * early
STEP_MIN_POINTS = 10  # n >=
STEP_TAIL_SHARE = 0.2
LOADER_SHARE = 0.5  # median share >

COMPARE_MIN_POINTS = 10  # n >=
FLOOR_RATIO = 2.0  # run > v * base
END_RATIO = 2.0  # run > v * base
IMPROVEMENT_FRACTION = 0.25  # run < v * base
GRADNORM_RATIO = 5.0  # run > v * base

DEAD_CLASS_MIN_COVERAGE = 0.5  # coverage <
DEAD_CLASS_MAX_LISTED = 8  # missing <=

RAM_MARGIN_GB = 4.0  # margin <

WATCH_MIN_POINTS = 10  # losses >=
CALLBACK_CHECK_EVERY = 25
CALLBACK_MIN_POINTS = 10  # records >=
CALLBACK_TARGET_BATCHES = 32
DISCOVERY_MIN_RECORDS = 3  # records >=
STALL_SEC = 300
WATCH_INTERVAL_SEC = 10
IMPORT_TIMEOUT_SEC = 120.0
EVIDENCE_STEPS = 5
EVIDENCE_ROWS = 3
