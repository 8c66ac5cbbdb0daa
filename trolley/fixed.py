"""Fixed values.

Everything here must equal the dashboard's own values for the tables to come
out the same: words, labels, sentence templates, sizes, scales and the
default parameters of each view. Operators import them from here.
"""

# pandas' default missing-value words for CSV cells
# (case-sensitive, matched on the raw cell before any trimming).
NA_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Wide layout column names.
COUNT_COLUMN = "Item(s)"
ITEM_COLUMN_PATTERN = r"Item (\d+)"

# Label separators.
ITEM_SEPARATOR = ", "
RULE_ARROW = " → "
PAIR_SEPARATOR = " & "

# The share table's folded tail.
OTHERS = "Others"

# Rule insight sentences (format_string templates, %s = text).
INSIGHT_ABOVE = "Customers who buy **%s** are **%sx** more likely to also buy **%s** compared to random chance."
INSIGHT_EQUAL = "Items **%s** and **%s** are independent of each other."
INSIGHT_BELOW = "Customers who buy **%s** are less likely to buy **%s**."
CONFIDENCE_TEXT = "Confidence means: %s of customers who bought %s also bought %s"

# Rule graph node types and sizes, edge colour steps, width
# scale and hover template (format_string, %s = text).
NODE_ITEM = "item"
NODE_ITEMSET = "itemset"
ITEM_NODE_SIZE = 25
ITEMSET_NODE_SIZE = 35
COLOUR_STEPS = 11
EDGE_WIDTH_SCALE = 2.5
EDGE_HOVER = "%s → %s<br>Lift: %s<br>Confidence: %s<br>Support: %s"

# Scatter bubble scale.
BUBBLE_SCALE = 50.0

# View sizes and defaults.
MIN_BASKET_SIZE = 2
TOP_ITEMS = 20
TOP_SHARE = 10
TOP_ITEMSETS = 20
TOP_RULES = 20
TOP_RULES_CHART = 10
TOP_PAIRS = 10
DEFAULT_TOP_N = 10
DEFAULT_GRAPH_RULES = 20
HISTOGRAM_BINS = 20
DEFAULT_MIN_LIFT = 1.0
DEFAULT_MIN_SUPPORT = 0.02
DEFAULT_MIN_CONFIDENCE = 0.3
