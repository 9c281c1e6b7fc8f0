"""The engine on the provided sample tables: table adapter, named queries and their reference SQL."""
