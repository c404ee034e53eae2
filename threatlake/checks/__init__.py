"""Every operator as a query over the given tables, most with an equivalent SQL text."""
