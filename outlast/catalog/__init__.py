"""Every operator as a named query over the star-schema tables, with its SQL counterpart."""
