"""Relational operators over the tape: filters, projections, aggregates,
ordering, period series and the capped composite."""
