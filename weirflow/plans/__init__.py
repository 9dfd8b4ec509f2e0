"""Plans: how operators are put together, ordered and staged."""
