"""Fixed values and rule sets (topics, KPIs, keyword tables) used by the operators."""
