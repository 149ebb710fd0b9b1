"""DataFrame -> DataFrame operators (cleaning, enrichment, orders, shipping,
customers, calendar buckets, subtotals, statistics, packaging)."""
