"""Given names by which names of persons are found, common ones of Europe, the Americas and, transcribed, of Russia, the
Arab world, India and East Asia. Apart from the names that surrogates are made of."""

from __future__ import annotations

import os.path
import re

# Given names by gender; a name of both stands where it is commoner.
MALE = """
Aaron Abdul Abdullah Abel Abraham Achim Adam Adalbert Adolf Adrian Adrien Ahmad Ahmed Aidan Akira Alain Alan Albert Alberto Albrecht Alec Alejandro Aleksandr Aleksei Alessandro Alex Alexander Alexandre Alexandru Alexei Alexey Alexis Alfons Alfonso Alfred Alfredo Ali Allan Allen Alois Alonso Alvaro Álvaro Alvin Amir Amit Anders Andre André Andreas Andrei Andrej Andrés Andres Andrew Andrey Andrzej Andy Angelo Angus Anil Anselm Anthony Antoine Anton Antonio António Antti Archie Arjun Armand Armando Armin Arne Arno Arnold Arthur Artur Arturo Arvid Ashok Attila August Augustin Augusto Axel
Barry Bart Bartholomew Bastian Baptiste Ben Benedict Benedikt Benito Benjamin Bennett Benoit Benoît Bernard Bernardo Bernd Bernhard Bert Bertram Bill Billy Björn Bob Bobby Bodo Boris Brad Bradley Brandon Brendan Brent Brett Brian Bruce Bruno Bryan Burkhard Byron
Caleb Callum Calvin Cameron Camilo Carl Carlo Carlos Carsten Cecil Cédric Cesar César Chad Charles Charlie Chester Chris Christian Christoph Christophe Christopher Claude Claudio Claus Clemens Clément Cliff Clifford Clint Clive Clyde Cody Colin Connor Conrad Constantin Cornelius Corey Craig Curt Curtis Cyril
Daisuke Dale Damian Damien Dan Daniel Daniele Danny Dario Darius Darren David Davide Dean Deepak Denis Dennis Derek Dermot Detlef Diego Dieter Dietmar Dietrich Dilip Dimitri Dinesh Dirk Dmitri Dmitry Domenico Dominic Dominik Dominique Don Donald Doug Douglas Duncan Dustin Dwight Dylan
Earl Eberhard Eckhard Ed Eddie Edgar Edmond Edmund Eduard Eduardo Edward Edwin Egon Elias Elijah Elliot Emanuel Emil Emile Émile Emiliano Emilio Emmanuel Enrico Enrique Eric Erich Erik Ernest Ernesto Ernst Erwin Esteban Étienne Etienne Ethan Eugen Eugene Evan Evgeny Ewald Ezra
Fabian Fabien Fabio Fabrice Farid Federico Felipe Felix Félix Ferdinand Fergus Fernando Filip Filippo Finn Flavio Florent Florian Floyd Francesco Francis Francisco Franco François Francois Frank Franklin Franz Fred Freddie Frederic Frédéric Frederick Frederik Friedhelm Friedrich Fritz
Gabriel Gareth Gary Gaston Gavin Gene Geoff Geoffrey Georg George Georges Gerald Gerard Gérard Gerardo Gerd Gerhard Gernot Gert Giacomo Gianni Gilbert Gilles Giorgio Giovanni Giulio Giuseppe Glen Glenn Gonzalo Gordon Graham Grant Greg Gregor Gregory Grégoire Grigori Guido Guillaume Guillermo Gunnar Gunther Günter Günther Gustav Gustavo Guy
Hans Hamid Hannes Harald Harold Harry Hartmut Harvey Hasan Hassan Hector Héctor Heiko Heiner Heinrich Heinz Helge Helmut Hendrik Henning Henri Henrik Henry Herbert Hermann Hernán Hiroshi Holger Horst Howard Hubert Hugh Hugo Humberto Hussein
Ian Ibrahim Ignacio Igor Ilja Ilya Immanuel Ingo Isaac Isaiah Ismael Ivan Iván Ivo
Jack Jackson Jacob Jacques Jaime Jake Jakob James Jamie Jan Janis Jared Jarek Jason Javier Jay Jean Jeff Jeffrey Jens Jeremiah Jeremy Jérôme Jerome Jerry Jesse Jesús Jesus Jim Jimmy Joachim Joakim João Joaquín Joaquin Jochen Joe Joel Joël Joerg Johan Johann Johannes John Johnny Jon Jonas Jonathan Jordan Jordi Jorge Jörg Jörn José Jose Josef Joseph Joshua Josh Juan Juergen Jules Julian Julien Julio Julius Jürgen Jurgen Justin
Kai Kamal Karim Karl Karsten Kaspar Kazuo Keith Ken Kenji Kenneth Kent Kevin Khalid Kieran Kilian Kirk Klaus Klemens Knut Konrad Konstantin Kristian Krzysztof Kumar Kurt Kyle
Lachlan Lars Larry Laurent Lawrence Lee Leif Leo Leon León Leonard Leonardo Leonid Leopold Leroy Leslie Lester Levi Lewis Liam Linus Lionel Lloyd Logan Lorenz Lorenzo Lothar Lou Louis Luc Luca Lucas Lucien Ludger Ludovic Ludwig Luigi Luis Luís Luiz Lukas Luke Lutz
Magnus Mahmoud Maik Malcolm Manfred Manuel Marc Marcel Marcello Marcelo Marco Marcos Marcus Marek Mariano Mario Marius Mark Marko Markus Martin Martín Marvin Massimo Mathew Mathias Mathieu Mats Matt Matteo Matthew Matthias Matthieu Maurice Mauricio Maurizio Mauro Max Maxim Maxime Maximilian Mehmet Melvin Michael Michal Michel Michele Miguel Mihail Mikael Mike Mikhail Milan Milos Mitchell Mohamed Mohammad Mohammed Moritz Morris Moses Muhammad Murat Mustafa
Nathan Nathaniel Neil Nelson Nick Nicholas Nico Nicola Nicolas Nicolás Niels Nigel Nikita Niklas Nikolai Nikolaus Nikolay Nils Noah Noel Noël Norbert Norman
Olaf Oleg Oliver Olivier Omar Orlando Oscar Óscar Oskar Osman Oswald Othmar Otis Ottmar Otto Owen
Pablo Paolo Pascal Pasquale Pat Patrice Patricio Patrick Patrik Paul Paulo Pavel Pawel Pedro Per Percy Peter Petr Phil Philip Philipp Philippe Phillip Pierre Pieter Pietro Piotr Preston
Quentin Quincy
Rachid Rafael Rafaël Raimund Rainer Raj Rajesh Ralf Ralph Ramesh Ramón Ramon Randall Randolph Randy Raoul Raphael Raphaël Rashid Raul Raúl Ravi Ray Raymond Reginald Reiner Reinhard Reinhold Rémi René Rene Ricardo Riccardo Richard Rick Ricky Robert Roberto Robin Roderick Rodney Rodolfo Rodrigo Roger Roland Rolf Roman Romain Ron Ronald Ronnie Rory Ross Roy Ruben Rubén Rudi Rudolf Rüdiger Rupert Russell Ryan
Said Salvador Salvatore Sam Samir Samuel Sandro Sanjay Santiago Scott Sean Sebastian Sébastien Sergei Sergey Serge Sergio Seth Severin Shane Shaun Shawn Sidney Siegfried Sigmund Silvio Simon Solomon Spencer Stan Stanislav Stanley Stefan Stefano Steffen Stéphane Stephan Stephen Steve Steven Stewart Stuart Sunil Sven Sylvain
Tadeusz Takashi Tariq Ted Terence Terry Theo Theodor Theodore Thierry Thilo Thomas Thorsten Tiago Till Tim Timo Timothy Tobias Todd Tom Tomás Tomas Tomasz Tommy Toni Tony Torsten Travis Trevor Tristan Tyler
Udo Ulf Ulrich Umberto Uwe
Valentin Vasily Vernon Vicente Victor Víctor Vijay Viktor Vincent Vincenzo Vinzenz Vitali Vito Vittorio Vlad Vladimir Volker Volkmar
Wade Waldemar Wallace Walter Warren Wayne Wendelin Werner Wes Wesley Wilbur Wilfried Wilhelm Will Willem William Willi Willy Winfried Winston Wladimir Wojciech Wolf Wolfgang Wolfram
Xaver Xavier Yann Yannick Yasser Yuri Yusuf Yves Yvon Zachary Zoltan
Адам Александр Алексей Анатолий Андрей Антон Аркадий Артём Артур Богдан Борис Вадим Валентин Валерий Василий Виктор Виталий Владимир Владислав Всеволод Вячеслав Геннадий Георгий Герман Глеб Григорий Даниил Денис Дмитрий Евгений Егор Захар Иван Игорь Илья Кирилл Константин Лев Леонид Максим Марк Матвей Михаил Никита Николай Олег Павел Пётр Петр Роман Руслан Святослав Семён Сергей Станислав Степан Тарас Тимофей Тимур Фёдор Федор Филипп Эдуард Юрий Яков Ярослав
"""
FEMALE = """
Abigail Ada Adela Adelaide Adele Adèle Adelheid Adriana Adrienne Agatha Agathe Agnes Agnès Agnieszka Aida Aileen Aisha Alana Alba Alejandra Alessandra Alexandra Alexa Alice Alicia Alina Aline Alison Allison Alma Amalia Amanda Amelia Amélie Amina Amira Amy Ana Anastasia Andrea Angela Ángela Angelica Angelika Angelina Angie Anika Anita Anja Anke Ann Anna Annabel Anne Anneliese Annegret Annemarie Annette Annie Annika Antje Antoinette Antonella Antonia Anya April Ariane Ariel Arlene Ashley Astrid Audrey Aurora Aurore Ava
Barbara Bärbel Beate Beatrice Beatrix Beatriz Becky Belinda Bella Benedetta Berenice Bernadette Bernice Berta Bertha Beth Bethany Betty Beverly Bianca Birgit Birgitta Birte Blanca Bonnie Brenda Brigitta Brigitte Britta Brittany Brooke
Caitlin Camila Camilla Camille Candice Carina Carla Carlotta Carmen Carol Carole Carolin Carolina Caroline Carolyn Carrie Cassandra Catalina Caterina Catherine Cathy Cecilia Cécile Celeste Celia Céline Celine Chantal Charlene Charlotte Chelsea Cheryl Chiara Chloe Chloé Christa Christel Christiane Christina Christine Cindy Claire Clara Clarissa Claudia Claudine Clementine Colette Colleen Concepción Constance Constanze Consuelo Cora Corinna Corinne Cornelia Courtney Cristina Crystal Cynthia
Dagmar Daisy Dana Daniela Danielle Daphne Daria Dawn Debbie Deborah Debra Delia Delphine Denise Diana Diane Dina Dolores Dominika Donna Dora Doreen Doris Dorothea Dorothee Dorothy
Edeltraud Edith Edna Eileen Ekaterina Elaine Eleanor Elena Eleni Eleonora Elfriede Elif Elisa Elisabeth Elise Eliza Elizabeth Elke Ella Ellen Elli Elodie Élodie Eloise Elsa Elsbeth Else Elvira Emilia Emilie Émilie Emily Emma Emmanuelle Erica Erika Erin Esmeralda Esperanza Estelle Esther Ethel Eugenia Eugénie Eva Evangeline Eve Evelyn Evelyne
Fabienne Faith Fanny Fatima Federica Felicia Felicitas Fernanda Fiona Flora Florence Frances Francesca Francine Francisca Franka Franziska Françoise Frauke Frida Frieda Friederike
Gabriela Gabriele Gabriella Gabrielle Galina Gemma Genevieve Geneviève Georgia Georgina Geraldine Gerda Gerlinde Germaine Gertrud Gertrude Gesa Gillian Gina Ginger Gisela Giselle Giulia Gladys Gloria Grace Graciela Greta Gretchen Grit Gudrun Guadalupe Gwen Gwendolyn
Hanna Hannah Hannelore Hazel Heather Hedwig Heide Heidemarie Heidi Heike Helen Helena Helene Hélène Helga Hella Henriette Hermine Hilary Hilda Hilde Hildegard Hiltrud Holly Hope
Ida Ilona Ilse Imke Imogen Ina Inés Ines Inès Inga Inge Ingeborg Ingrid Irene Irina Iris Irma Irmgard Isabel Isabella Isabelle Isolde Ivana Ivonne Ivy
Jacqueline Jana Jane Janet Janice Janina Janine Jasmin Jasmine Jeanette Jeanne Jeannine Jennifer Jenny Jessica Jill Jo Joan Joana Joanna Joanne Jocelyn Johanna Josefa Josefina Josephine Joséphine Joy Joyce Juana Juanita Judith Judy Julia Juliana Juliane Julie Juliet Juliette June Justine Jutta
Karen Karin Karina Karla Karoline Kate Katharina Katherine Kathleen Kathrin Kathryn Kathy Katie Katja Katrin Kayla Kelly Kerstin Kim Kimberly Kirsten Klara Konstanze Kristen Kristin Kristina Kristine Krystyna
Lara Larissa Laura Lauren Laurence Laurie Layla Lea Léa Leah Leila Lena Lenka Leona Leonie Leonore Leticia Lidia Lieselotte Lilian Liliana Lillian Lilly Lily Lina Linda Lindsay Lisa Lisbeth Liselotte Livia Lois Lola Loretta Lorraine Lotte Louisa Louise Lourdes Luana Lucia Lucía Lucie Lucille Lucinda Lucy Ludmila Luise Luisa Luz Lydia Lynn
Mabel Madeleine Madison Magda Magdalena Maggie Maike Maja Malika Mandy Manon Manuela Marcela Marcella Marcia Mareike Margaret Margarete Margarethe Margarita Margaux Margherita Margit Margot Margret Marguerite Maria María Mariam Mariana Marianne Maribel Marie Mariella Marilyn Marina Marion Marisa Marisol Marjorie Marlene Marlies Marta Martha Martina Martine Mary Maryam Mathilde Matilda Maud Maureen Maxine Maya Mechthild Megan Melanie Mélanie Melinda Melissa Mercedes Meredith Michaela Michelle Mildred Mina Minna Mira Miranda Miriam Moira Molly Mona Monica Mónica Monika Monique Montserrat Muriel Myriam Myrtle
Nadia Nadine Nadja Nancy Naomi Natalia Natalie Natascha Natasha Nathalie Nela Nelly Nicole Nina Noelle Noemi Noémie Nora Noreen Norma
Octavia Odette Olga Olive Olivia Ophelia Oriana Orla
Paloma Pamela Patricia Patrizia Patsy Paula Paulette Paulina Pauline Pearl Peggy Penelope Penny Petra Philippa Phoebe Phyllis Pia Pilar Polly Priscilla Priya
Rachel Raffaella Ramona Raquel Rebecca Regina Regine Reinhild Renata Renate Renée Rhonda Rita Roberta Rocío Romy Rosa Rosalie Rosalind Rosalinda Rosanna Rosario Rose Roselinde Rosemarie Rosemary Rosie Roswitha Roxana Ruth
Sabina Sabine Sabrina Sally Samantha Samira Sandra Sandrine Sara Sarah Saskia Savannah Selina Selma Sharon Sheila Shelley Sherry Shirley Sibylle Sieglinde Sigrid Silke Silvia Simona Simone Sinead Sofia Sofía Solange Sonia Sonja Sophia Sophie Stacy Stefania Stefanie Stella Stephanie Stéphanie Sue Susan Susana Susann Susanna Susanne Suzanne Svenja Svetlana Swetlana Sybille Sylvia Sylvie
Tabea Tamara Tania Tanja Tara Tatiana Tatjana Teresa Terri Tessa Thea Thelma Theresa Therese Thérèse Tiffany Tina Tracy Trudy
Ulla Ulrike Ursel Ursula Uta Ute
Valentina Valeria Valerie Valérie Vanessa Vera Verena Veronica Verónica Veronika Véronique Vicky Victoria Viktoria Violet Viola Virginia Virginie Vivian Viviane
Walburga Waltraud Wanda Wendy Wilhelmine Wilma Winifred Xenia Ximena Yasmin Yasmine Yolanda Yvette Yvonne Zara Zoe Zoé Zofia
Александра Алёна Алина Алиса Алла Анастасия Ангелина Анна Антонина Валентина Валерия Варвара Василиса Вера Вероника Виктория Галина Дарья Диана Евгения Екатерина Елена Елизавета Жанна Зинаида Зоя Инна Ирина Карина Кира Клавдия Кристина Ксения Лариса Лидия Любовь Людмила Маргарита Марина Мария Надежда Наталия Наталья Нина Оксана Ольга Полина Раиса Регина Римма Светлана София Софья Тамара Татьяна Ульяна Юлия Яна Белла
"""


def pattern_of(words: list[str]) -> str:
    """An expression for any of the words that tries each letter once: words of one begin share it."""
    some = sorted(set(words))
    start = os.path.commonprefix(some)
    rest = [w[len(start) :] for w in some]
    if len(rest) == 1:
        return re.escape(start)
    heads: dict[str, list[str]] = {}
    for w in filter(None, rest):
        heads.setdefault(w[0], []).append(w)
    inner = "|".join(pattern_of(ws) for ws in heads.values())
    return re.escape(start) + f"(?:{inner})" + ("" if rest[0] else "?")
