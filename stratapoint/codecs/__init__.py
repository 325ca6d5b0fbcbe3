"""Binary tile contents: encoders and decoders on NumPy arrays."""
