"""Where operation logs come from and where state goes."""
