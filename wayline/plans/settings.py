"""Parameters of the registered queries: small chunks, for trajectories of 45 to 99 points."""

K, Q = 16, 2
Q1, Q2 = 2, 2
DRAWS = 5
#: First shard of the validation and of the test split.
SPLIT = (26, 29)
DELTA = 37.5
MODELS = (0.1, 0.2, 0.3)
#: Delta and rounds of the velocity fit; about half of the residuals lie beyond this delta.
FIT_DELTA, FIT_ROUNDS = 5.0, 4
