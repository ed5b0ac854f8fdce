"""Ten rows of a public housing data set, and the models expected of them (fixed values)."""

# Thirteen features and the target of each row.
ROWS = """
0.00632 18 2.31 0 0.538 6.575 65.2 4.09 1 296 15.3 396.9 4.98 24.0
0.02731 0 7.07 0 0.469 6.421 78.9 4.9671 2 242 17.8 396.9 9.14 21.6
0.02729 0 7.07 0 0.469 7.185 61.1 4.9671 2 242 17.8 392.83 4.03 34.7
0.03237 0 2.18 0 0.458 6.998 45.8 6.0622 3 222 18.7 394.63 2.94 33.4
0.06905 0 2.18 0 0.458 7.147 54.2 6.0622 3 222 18.7 396.9 5.33 36.2
0.02985 0 2.18 0 0.458 6.43 58.7 6.0622 3 222 18.7 394.12 5.21 28.7
0.08829 12.5 7.87 0 0.524 6.012 66.6 5.5605 5 311 15.2 395.6 12.43 22.9
0.14455 12.5 7.87 0 0.524 6.172 96.1 5.9505 5 311 15.2 396.9 19.15 27.1
0.21124 12.5 7.87 0 0.524 5.631 100 6.0821 5 311 15.2 386.63 29.93 16.5
0.17004 12.5 7.87 0 0.524 6.004 85.9 6.5921 5 311 15.2 386.71 17.1 18.9
"""

INF = float("inf")

# Method, depth, and of each tree the features, thresholds and leaf weights.
MODELS = [
    ("exact", 1, [([6], [65.1999969], [32.7496719, 21.3331203])]),
    ("exact", 2, [([6, 5, 0], [65.1999969, 7.14699984, 0.170039997], [30.549696, 34.9496498, 23.399765, 17.1998291])]),
    ("exact", 3, [([6, 5, 0, 0, 0, 0, 0], [65.1999969, 7.14699984, 0.170039997, INF, INF, 0.0882899985, INF], [30.549696, 0.0, 34.9496498, 0.0, 22.2997761, 24.499754, 17.1998291, 0.0])]),
    ("exact", 1, [([6], [65.1999969], [32.7496719, 21.3331203]), ([11], [394.630005], [-2.84136748, 1.89467728])]),
    ("exact", 2, [([6, 5, 0], [65.1999969, 7.14699984, 0.170039997], [30.549696, 34.9496498, 23.399765, 17.1998291]), ([0, 0, 5], [0.0323700011, 0.0273100007, 6.17199993], [-0.324703783, -2.32470655, -0.333137989, 2.10027623])]),
    ("exact", 3, [([6, 5, 0, 0, 0, 0, 0], [65.1999969, 7.14699984, 0.170039997, INF, INF, 0.0882899985, INF], [30.549696, 0.0, 34.9496498, 0.0, 22.2997761, 24.499754, 17.1998291, 0.0]), ([6, 0, 11, 0, 0, 11, 0], [58.7000008, INF, 396.899994, INF, INF, 394.119995, INF], [1.55031276, 0.0, 0.0, 0.0, -0.249766707, -2.2247026, 0.700224519, 0.0])]),
    ("hist", 1, [([6], [63.1499977], [32.7496719, 21.3331203])]),
    ("hist", 2, [([6, 5, 0], [63.1499977, 7.07250023, 0.157294989], [30.549696, 34.949646, 23.3997669, 17.1998253])]),
    ("hist", 3, [([6, 5, 0, 0, 0, 0, 0], [63.1499977, 7.07250023, 0.157294989, INF, INF, 0.0786699951, INF], [30.549696, 0.0, 34.949646, 0.0, 22.2997799, 24.499754, 17.1998253, 0.0])]),
    ("hist", 1, [([6], [63.1499977], [32.7496719, 21.3331203]), ([11], [394.375], [-2.84136748, 1.89467728])]),
    ("hist", 2, [([6, 5, 0], [63.1499977, 7.07250023, 0.157294989], [30.549696, 34.9496498, 23.399765, 17.1998291]), ([0, 0, 5], [0.0311099999, 0.0273000002, 6.09200001], [-0.324703783, -2.32470655, -0.333137989, 2.10027623])]),
    ("hist", 3, [([6, 5, 0, 0, 0, 0, 0], [63.1499977, 7.07250023, 0.157294989, INF, INF, 0.0786699951, INF], [30.549696, 0.0, 34.949646, 0.0, 22.2997799, 24.499754, 17.1998253, 0.0]), ([6, 0, 11, 0, 0, 11, 0], [56.4500008, INF, 396.25, INF, INF, 393.474976, INF], [1.55031466, 0.0, 0.0, 0.0, -0.249762893, -2.2247026, 0.700221956, 0.0])]),
]


def rows():
    return [[float(x) for x in line.split()] for line in ROWS.strip().splitlines()]
