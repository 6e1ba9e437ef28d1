"""Terms and expressions."""
