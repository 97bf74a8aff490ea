"""Table operators: rules, dedupe/rank/select, lookups, text-to-table parsers,
the generation hook."""
