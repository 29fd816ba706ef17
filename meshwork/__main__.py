from meshwork.cli import main

raise SystemExit(main())
