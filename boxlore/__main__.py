from boxlore.jobs import main

main()
