"""Column-level functions: text, formula, labels."""

from cribra.functions.formula import (counts_text, formula_counts, formula_ratio,  # noqa: F401
                                      gcd2, ratio_text, reduced_counts, same_reduced,
                                      scale_counts)
from cribra.functions.labels import (bin_label, crystal_system, equal_pattern,  # noqa: F401
                                     range_label, ratio_bin_if)
from cribra.functions.text import (bool_text, cut_from_marker, join_keys, json_list,  # noqa: F401
                                   normalize_ws, prompt_body, remove_ws, render_prompt,
                                   safe_stem, strip_ws, tagged_block, tagged_block_error,
                                   text_or_empty, token_budget, token_budget_error)
