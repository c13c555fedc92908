"""Reading inputs, storing and loading summary states."""
