"""Composite plans: the batch run, the service run and the dense run, plus
the catalog of registered queries (one per operator of the inventory)."""
