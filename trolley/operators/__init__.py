"""DataFrame operators: baskets, mining, items, rules, co-occurrence,
histograms and rule graphs."""
