"""Mining, selection, rules, classification, induction and clustering operators."""
