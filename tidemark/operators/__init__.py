"""DataFrame operators: crawlers, sessions, trees, mining, matrices, rules, linkage, search."""
