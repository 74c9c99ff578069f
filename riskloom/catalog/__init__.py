"""Every operator as a query over the given tables, each with its SQL counterpart where there is one."""
