"""Column functions: measures, itemset algebra and text helpers."""
