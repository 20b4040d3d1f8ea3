"""The rule-pack language."""
